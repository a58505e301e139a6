"""Benchmark decontamination by template canonicalisation.

Texts are cut into words; numbers, names and units become typed placeholders. Windows of the resulting templates are
hash-joined with those of the benchmark, and the values in the slots of aligned windows must map one to one, so that a
question with other numbers and names is caught while an accidental template is not. Every window counts in a second,
literal form too, all its words as they are but for case and outer punctuation, so that a verbatim copy is found whatever
its placeholders and whatever stands before it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.store import Scratch

#: Words of a template window, and of the window for items too short for it; items of fewer words are not looked for.
WINDOW, SHORT = 8, 4
#: Words of a window that must be no placeholder.
LITERALS = {8: 4, 4: 2}
#: Share of an item's windows that a document must hold.
LEAST_SHARE = 0.5
#: Bits of the filter that windows pass before they are joined; its size is fixed, a large benchmark only fills it.
FILTER_BITS = 1 << 18

PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|«»„“”‚‘’…-–—"
#: Units of measure that follow a number.
UNITS = ("%", "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "s", "sec", "min", "h", "hr", "hrs",
         "day", "days", "week", "weeks", "month", "months", "year", "years", "hour", "hours", "minute", "minutes", "second", "seconds", "meter", "meters",
         "metre", "metres", "mile", "miles", "inch", "inches", "foot", "feet", "gram", "grams", "kilogram", "kilograms", "liter", "liters", "litre", "litres",
         "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "degree", "degrees", "c", "f", "k", "w", "kw", "v", "hz")
NUMBER, NAME, UNIT = 1, 2, 3


def raw_words(text) -> F.Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def _let(value, body) -> F.Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digit(c) -> F.Column:
    return (c >= "0") & (c < ":")


def _capital(t) -> F.Column:
    opens = F.substring(F.btrim(t, F.lit(PUNCTUATION)), 1, 1)
    return (F.lower(t) != t) & (opens != F.lower(opens))


def _template(words, cores, literal) -> F.Column:
    """Hash of every word of a column of words; 1 for numbers, 2 for names, 3 for units.

    A number starts with a digit. A unit follows a number. A name has a capital first letter and neither starts the text
    nor follows the end of a sentence. All other words count without case and outer punctuation: ``cores``, hashed."""
    def one(t, i):
        core, before = F.get(cores, i), F.get(words, i - 1)
        starts = before.isNull() | F.substring(before, -1, 1).isin(".", "!", "?")
        return (F.when(_digit(core), F.lit(NUMBER).cast("long"))
                .when(_capital(t) & ~starts, F.lit(NAME).cast("long"))
                .when(before.isNotNull() & _digit(F.get(cores, i - 1)) & core.isin(*UNITS), F.lit(UNIT).cast("long"))
                .otherwise(F.get(literal, i)))
    return F.transform(words, one)


def _doubled(h, step: int) -> F.Column:
    """Hashes of windows twice as long, from those of windows of ``step`` words."""
    n = F.size(h) - step
    return F.when(n > 0, F.zip_with(F.slice(h, F.lit(1), F.greatest(n, F.lit(1))), F.slice(h, F.lit(step + 1), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))).otherwise(
        F.expr("cast(array() as array<bigint>)"))


def _both(h1, body) -> F.Column:
    """``body(h4, h8)``: the hashes of windows of 4 and 8 words."""
    return _let(_doubled(h1, 1), lambda h2: _let(_doubled(h2, 2), lambda h4: _let(_doubled(h4, 4), lambda h8: body(h4, h8))))


def _windowed(text, body) -> F.Column:
    """``body(words, h1, h4, h8, l1, l4, l8)`` of a text: its words, their template and its windows, and the same of their
    literal form."""
    core = lambda t: F.btrim(F.lower(t), F.lit(PUNCTUATION))
    return _let(raw_words(text), lambda w: _let(F.transform(w, core), lambda c: _let(F.transform(c, lambda x: F.xxhash64(x)), lambda l1: _let(_template(w, c, l1), lambda h1: _both(
        h1, lambda h4, h8: _both(l1, lambda l4, l8: body(w, h1, h4, h8, l1, l4, l8)))))))


def benchmark_windows(bench: DataFrame, scratch: Scratch, item_id: str, text: str) -> DataFrame:
    """(hash, item_id, ipos, template, literal, iwords, slots, width, t_windows, l_windows): the windows of each item, as
    templates where they hold enough literal words, and as literals.

    An item's first word counts as a word in its template; where it has a capital, a second template counts it as a name,
    which it is in a document where no end of a sentence stands before it."""
    df = bench.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null and item_id is not null").dropDuplicates()
    parts = _windowed(F.col("text"), lambda w, h1, h4, h8, l1, l4, l8: F.struct(w.alias("words"), h1.alias("h1"), h4.alias("h4"), h8.alias("h8"), l4.alias("l4"), l8.alias("l8")))
    df = scratch.cut(df.select("item_id", parts.alias("x"))).select("item_id", "x.*")
    out = None
    for width, h, lit in ((WINDOW, "h8", "l8"), (SHORT, "h4", "l4")):
        fits = F.size("words") >= WINDOW if width == WINDOW else (F.size("words") < WINDOW) & (F.size("words") >= SHORT)
        rows = df.where(fits).select("item_id", F.posexplode(F.arrays_zip(F.col(h).alias("h"), F.col(lit).alias("l"))).alias("ipos", "x"), "words", "h1")
        rows = rows.select("item_id", "ipos", "x.h", "x.l", F.slice("words", F.col("ipos") + 1, F.lit(width)).alias("iwords"), F.slice("h1", F.col("ipos") + 1, F.lit(width)).alias("slots"), F.lit(width).alias("width"))
        enough = F.size(F.filter("slots", lambda s: ~s.isin(NUMBER, NAME, UNIT))) >= LITERALS[width]
        columns = lambda hash, template, literal: [F.col(hash).alias("hash"), "item_id", "ipos", template.alias("template"), literal.alias("literal"), "iwords", "slots", "width"]
        named = rows.where((F.col("ipos") == 0) & _capital(F.get("iwords", F.lit(0))) & ~_digit(F.btrim(F.get("iwords", F.lit(0)), F.lit(PUNCTUATION))))
        named = named.withColumn("slots", F.concat(F.array(F.lit(NAME).cast("long")), F.slice("slots", 2, width - 1)))
        named = named.withColumn("h", _both(F.col("slots"), lambda h4, h8: F.get(h8 if width == WINDOW else h4, F.lit(0))))
        # a window without placeholders has one hash in both forms
        for part in (rows.where(enough).select(*columns("h", F.lit(True), F.col("h") == F.col("l"))), rows.where("h <> l").select(*columns("l", F.lit(False), F.lit(True))),
                     named.where(enough).select(*columns("h", F.lit(True), F.lit(False)))):
            out = part if out is None else out.union(part)
    out = scratch.cut(out)
    totals = out.groupBy("item_id", "width").agg(*[F.size(F.collect_set(F.when(F.col(c), F.struct("ipos", F.col("iwords"))))).cast("long").alias(f"{c[0]}_windows") for c in ("template", "literal")])
    return out.join(totals, ["item_id", "width"])


def _filter_test(windows: DataFrame, width: int):
    """A test on hashes that every window of the benchmark passes, and few others; None if there is no such window."""
    bit = F.pmod("hash", F.lit(FILTER_BITS))
    rows = windows.where(F.col("width") == width).groupBy(F.floor(bit / 62).cast("int").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(62)).cast("int"))).alias("bits"))
    cells = [0] * (FILTER_BITS // 62 + 1)
    for r in rows.collect():  # at most one row per cell
        cells[r["cell"]] = r["bits"]
    if not any(cells):
        return None
    held = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")

    def test(h):
        b = F.pmod(h, F.lit(FILTER_BITS))
        return F.call_function("shiftright", F.get(held, F.floor(b / 62).cast("int")), F.pmod(b, F.lit(62)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return test


def find_leaks(docs: DataFrame, bench: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, windows, matched, share, exact, start_word, stop_word, th): documents that hold a benchmark item.

    ``share`` is the part of the item's windows found in the document, as templates or as literals, whichever is more. Of
    the windows in one alignment those do not count that hold a value which stands for two values of the other side;
    ``exact`` tells whether all values that count are the item's own. A document that holds an item twice is one row. Null
    and empty texts, on either side, match nothing. Rows that repeat an id, or have none, are told apart by ``th``, the
    hash of their text. Items of under ``SHORT`` words are not looked for.
    """
    windows = scratch.cut(benchmark_windows(bench, scratch, item_id, item_text))
    tests = {width: _filter_test(windows, width) for width in (WINDOW, SHORT)}

    def passing(w, h1, h4, h8, l1, l4, l8):
        parts = [F.expr("cast(array() as array<struct<hash: bigint, pos: int, dwords: array<string>, width: int>>)")]
        for width, h, lit in ((WINDOW, h8, l8), (SHORT, h4, l4)):
            test = tests[width]
            if test is not None:
                found = (F.transform(h, lambda x, i: F.when(test(x), F.struct(x.alias("hash"), i.alias("pos")))),
                         F.transform(lit, lambda x, i: F.when((x != F.get(h, i)) & test(x), F.struct(x.alias("hash"), i.alias("pos")))))
                for at in (F.filter(f, lambda s: s.isNotNull()) for f in found):
                    parts.append(F.transform(at, lambda s: F.struct(s["hash"].alias("hash"), s["pos"].alias("pos"), F.slice(w, s["pos"] + 1, F.lit(width)).alias("dwords"), F.lit(width).alias("width"))))
        return F.concat(*parts)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("text is not null")
    hits = rows.select("doc_id", "th", F.explode(_windowed(F.col("text"), passing)).alias("x")).select("doc_id", "th", "x.*")
    pairs = hits.join(windows, ["hash", "width"])
    bare = lambda c: F.lower(F.btrim(c, F.lit(PUNCTUATION)))
    each = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.when(F.get("slots", j).isin(NUMBER, NAME, UNIT), F.struct(bare(F.get("iwords", j)).alias("i"), bare(F.get("dwords", j)).alias("d"))))
    pairs = pairs.withColumn("filled", F.filter(each, lambda s: s.isNotNull())).withColumn("line", F.col("pos") - F.col("ipos"))
    lines = pairs.groupBy("doc_id", "th", "item_id", "line", "t_windows", "l_windows", "width").agg(F.collect_set(F.struct("ipos", "template", "literal", "filled")).alias("all"))
    lines = lines.withColumn("values", F.array_distinct(F.flatten(F.transform("all", lambda x: x["filled"]))))
    lines = lines.withColumn("torn", F.filter("values", lambda s: F.exists("values", lambda r: (r["i"] == s["i"]) != (r["d"] == s["d"]))))
    lines = lines.withColumn("held", F.filter("all", lambda x: ~F.arrays_overlap(x["filled"], F.col("torn")))).where(F.size("held") > 0)
    at = lambda form: F.transform(F.filter("held", lambda x: x[form]), lambda x: x["ipos"])
    found = lines.select("doc_id", "th", "item_id", "t_windows", "l_windows", at("template").alias("t"), at("literal").alias("l"), "line", "width",
                         F.forall("held", lambda x: F.forall(x["filled"], lambda s: s["i"] == s["d"])).alias("own"), F.transform("held", lambda x: x["ipos"]).alias("at"))
    found = found.groupBy("doc_id", "th", "item_id", "t_windows", "l_windows").agg(
        *[F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long").alias(c) for c in ("t", "l")], F.min(F.col("line") + F.array_min("at")).cast("long").alias("start_word"),
        F.max(F.col("line") + F.array_max("at") + F.col("width")).cast("long").alias("stop_word"), F.min("own").alias("exact"))
    share = lambda c: F.when(F.col(f"{c}_windows") > 0, F.col(c) / F.col(f"{c}_windows")).otherwise(0.0)
    best = F.when(share("t") >= share("l"), F.struct(F.col("t_windows").alias("windows"), F.col("t").alias("matched"), share("t").alias("share"))).otherwise(
        F.struct(F.col("l_windows").alias("windows"), F.col("l").alias("matched"), share("l").alias("share")))
    found = found.withColumn("best", best).where(F.col("best.share") >= least_share)
    return found.select("doc_id", "item_id", "best.*", "exact", "start_word", "stop_word", "th")
