"""Leave-one-out assessment: every fold (one recording, or several) is scored with bars and a cell chosen without it.

A refit is a subtraction. The full curve is summed up once, in score bins; taking a fold out shifts the curve by constants
between the fold's own scores, so the point where a precision floor is last held is found by range maxima over bins, and
only bins where it can lie are looked into score by score. Few points of a curve can be any fold's answer, so folds whose own
rows lie alike between these points have the same thetas, and one of them is refitted for all. Folds that share thetas share
their counts: a detection is placed once among the distinct thetas of its species, counts at any theta follow from running
sums, and the cells of a sweep are added up once per species and distinct set of thetas, over the distinct lists of counts. A
fold's sweep is the sum over species less its own pairs, taken only in the cells that can be chosen without any of the folds.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorale.operators.intervals import span_counts
from chorale.operators.prefix import running_totals, score_bin
from chorale.operators.survey import COL, ORDER, OUT, PAIR, STATS, Cells, limits, outcome_of, per_recording
from chorale.operators.curves import tie_counts
from chorale.params import FIRM_FLOORS, FLOORS, KS, Constraints, RuleSpec, SurveyRule
from chorale.session import cut, spread

#: Folds that share a cell of work, and recordings that do.
FOLD_BLOCK, RECORDING_BLOCK = 4096, 4096
#: Folds whose cells are chosen in one task.
CHOICE_BLOCK = 4096
#: Folds of such a task whose cells are looked at together.
TOGETHER = 256
#: Points of a curve that may be some fold's answer, up to which every fold is held against all of them.
CLOSE = 512
#: Distinct scores of a bucket of bins, which are looked into together; a bin has fewer (``prefix.score_bin``).
BUCKET = 1 << 14
#: Cells of a table of questions by scores that is made at once.
TABLE = 1 << 20


def fold_ties(aligned: DataFrame, keys: list[str], folds: DataFrame) -> DataFrame:
    """Tie counts that keep the fold of their recording: the one table every refit subtracts from."""
    return tie_counts(aligned.join(folds, "recording_id"), [*keys, "fold"])


def _apart(df: DataFrame) -> DataFrame:
    """The same frame under columns of its own, so that it can meet a frame that was made from it."""
    return df.toDF(*df.columns)


# ------------------------------------------------------------------ thetas
def _exact(floors) -> tuple[np.ndarray, np.ndarray]:
    """Floors as numerators and denominators, so that precision >= floor is a comparison of whole numbers."""
    parts = [Fraction(repr(float(f))) for f in floors]
    return np.array([p.numerator for p in parts], np.int64), np.array([p.denominator for p in parts], np.int64)


def _last_at_least(table: list[np.ndarray], low, high, want) -> np.ndarray:
    """Greatest position in [low, high] whose value reaches ``want``, else -1; ``table[k]`` holds maxima of 2^k positions."""
    at, least = high.copy(), low
    for k in range(len(table) - 1, -1, -1):
        whole = at - (1 << k) + 1 >= least
        skip = whole & (table[k][np.where(whole, at, 0)] < want)
        at = np.where(skip, at - (1 << k), at)
    return np.where(at >= least, at, -1)


def _candidates(own: pd.DataFrame, bins: pd.DataFrame, floors, min_support: int) -> pd.DataFrame:
    """(fold, floor number, bin, own tp and rows before the bin): the bins in which a fold's point may lie. Number -1 asks
    for the first point with enough rows. ``own``: (fold, bin, p, n) with one row of no bin per fold."""
    num, den = _exact(floors)
    bins = bins.sort_values("bin", ascending=False, kind="stable")
    order, seen = bins["bin"].to_numpy(np.int64), bins["seen_end"].to_numpy(np.int64)
    g = np.array([np.where(pd.isna(bins[f"g{f}"]), -(2 ** 62), bins[f"g{f}"].fillna(0)).astype(np.int64) for f in range(len(num))])
    tables = []
    for row in g:
        table = [row]
        while 2 << (len(table) - 1) <= len(row):
            half = 1 << (len(table) - 1)
            longer = table[-1].copy()
            longer[half:] = np.maximum(table[-1][half:], table[-1][:-half])
            table.append(longer)
        tables.append(table)
    code, ids = pd.factorize(own["fold"])
    real = own["bin"].notna().to_numpy()
    where = len(order) - 1 - np.searchsorted(order[::-1], own["bin"].fillna(0).to_numpy(np.int64))
    own = pd.DataFrame({"f": code, "b": np.where(real, where, -1), "p": own["p"].to_numpy(np.int64), "n": own["n"].to_numpy(np.int64)}).sort_values(["f", "b"], kind="stable")
    f, b, p, n = (own[c].to_numpy(np.int64) for c in "fbpn")
    before = own.groupby("f")[["p", "n"]].cumsum().to_numpy(np.int64)  # after this own bin
    tp, sn = before[:, 0], before[:, 1]
    last = np.append(f[1:] != f[:-1], True)
    top = np.where(last, len(order) - 1, np.append(b[1:], 0) - 1)  # the stretch of bins after this own bin, up to the next
    out = []
    for i in range(len(num)):
        free = _last_at_least(tables[i], b + 1, np.maximum(top, b), den[i] * tp - num[i] * sn)
        free[top <= b] = -1
        sure = pd.Series(free).groupby(f).transform("max").to_numpy()
        hit = (free >= 0) & (free == sure)
        out.append((f[hit], np.full(hit.sum(), i), free[hit], tp[hit], sn[hit]))
        may = (b > sure) & (b >= 0) & (g[i][np.maximum(b, 0)] >= den[i] * (tp - p) - num[i] * sn)
        out.append((f[may], np.full(may.sum(), i), b[may], (tp - p)[may], (sn - n)[may]))
    # the first bin at whose end enough rows of the other folds have been seen
    at = np.searchsorted(seen, min_support + sn)  # within the stretch after each own bin
    stretch = (at > b) & (at <= top)
    inside = (b >= 0) & (seen[np.maximum(b, 0)] - sn >= min_support)
    first = np.where(inside, b, np.where(stretch, at, len(order)))
    lowest = pd.Series(first).groupby(f).transform("min").to_numpy()
    pick = (first == lowest) & (first < len(order))
    out.append((f[pick], np.full(pick.sum(), -1), first[pick], np.where(inside, tp - p, tp)[pick], np.where(inside, sn - n, sn)[pick]))
    f, i, b, tp, sn = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"fold": np.asarray(ids)[f], "i": i, "bucket": bins["bucket"].to_numpy()[b], "bin": order[b], "tp_before": tp, "n_before": sn})


def _points(asked: pd.DataFrame, ties: pd.DataFrame, floors, min_support: int) -> pd.DataFrame:
    """(fold, floor number, tp, seen, theta) of the candidates that hold. ``ties``: their bins' rows of all folds together
    (fold null; tp and seen up to each score) and of single folds."""
    bins = dict(list(ties.groupby("bin")))
    out = [_points_of_bin(part, bins[b], floors, min_support) for b, part in asked.groupby("bin")]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["fold", "i", "tp", "seen", "theta"])


def _points_of_bin(asked: pd.DataFrame, ties: pd.DataFrame, floors, min_support: int) -> pd.DataFrame:
    """The points of one bin: a row of a table per question, a column per score. Folds without rows in the bin that ask the
    same are one row, and tables are cut where they grow large."""
    num, den = _exact(floors)
    whole = ties[ties["fold"].isna()].sort_values("score", ascending=False)
    score, p, n, tp, seen = (whole[c].to_numpy() for c in ("score", "p", "n", "tp", "seen"))
    own = ties[ties["fold"].notna()]
    code, ids = pd.factorize(own["fold"])
    at = len(score) - 1 - np.searchsorted(score[::-1], own["score"].to_numpy())
    order = np.argsort(code, kind="stable")
    code, at, own_p, own_n = code[order], at[order], own["p"].to_numpy()[order], own["n"].to_numpy()[order]
    q = pd.DataFrame({"mine": pd.Index(ids).get_indexer(asked["fold"]), "i": asked["i"].to_numpy(), "a": asked["tp_before"].to_numpy(), "s": asked["n_before"].to_numpy()})
    same = q.groupby(["mine", "i", "a", "s"]).ngroup().to_numpy()
    q = q.drop_duplicates().sort_values(["mine", "i", "a", "s"])  # in the order of the group numbers
    mine, i, a, s = (q[c].to_numpy(np.int64) for c in ("mine", "i", "a", "s"))
    place, got_tp, got_seen = (np.full(len(q), -1, np.int64) for _ in range(3))
    step = max(1, TABLE // max(len(score), 1))
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        first, last = max(mine[part][0], 0), mine[part][-1] + 1
        mine_at = np.arange(*np.searchsorted(code, [first, last]))
        op, on = (np.zeros((last - first + 1, len(score)), np.int64) for _ in range(2))  # the last row: no rows of its own
        op[code[mine_at] - first, at[mine_at]], on[code[mine_at] - first, at[mine_at]] = own_p[mine_at], own_n[mine_at]
        which = np.where(mine[part] >= 0, mine[part] - first, last - first)
        op, on, f = op[which], on[which], i[part, None]
        t, r = tp - a[part, None] - np.cumsum(op, axis=1), seen - s[part, None] - np.cumsum(on, axis=1)
        ok = (r >= min_support) & np.where(f < 0, n > on, (p > op) & (den[f] * t >= num[f] * r))
        pick = np.where(f[:, 0] < 0, ok.argmax(axis=1), ok.shape[1] - 1 - ok[:, ::-1].argmax(axis=1))
        row = np.arange(len(pick))
        place[part], got_tp[part], got_seen[part] = np.where(ok.any(axis=1), pick, -1), t[row, pick], r[row, pick]
    hit = place[same] >= 0
    found = same[hit]
    return pd.DataFrame({"fold": asked["fold"].to_numpy()[hit], "i": asked["i"].to_numpy()[hit], "tp": got_tp[found], "seen": got_seen[found], "theta": score[place[found]].astype(float)})


def _alike_folds(ties: DataFrame, curve: DataFrame, keys: list[str], folds: DataFrame, floors, min_support: int) -> tuple[DataFrame, DataFrame]:
    """(keys, fold, like, own): every fold with what its thetas depend on, and its positives. Folds with the same ``like``
    have the same thetas. And the points these lie among: (keys, place, score, p, n, tp, seen, asked), ``asked`` telling for
    each floor, and last for the first point with enough rows, whether it may be there.

    A point of the curve is open if it can hold a floor without some fold, going by the most rows that any fold has. Where
    it holds without every fold, only a fold with all its positives can take it away, which no fold can do to more points
    than it has positives: so the points that are open, and not higher than one more of these, hold every fold's answer.
    ``like`` lists the fold's rows at these points and between them; rows below the last one change nothing."""
    num, den = _exact(floors)
    sizes = cut(ties.groupBy(*keys, "fold").agg(F.sum("p").alias("own"), F.sum("n").alias("_n")))
    most = sizes.groupBy(*keys).agg(F.max("own").alias("_p"), F.max("_n").alias("_rows"), F.max(F.col("_n") - F.col("own")).alias("_neg"))
    at = range(len(num))
    gain = [F.col("tp") * int(d) - F.col("seen") * int(m) for m, d in zip(num, den)]
    some, enough = (F.col("p") > 0) & (F.col("seen") >= min_support), F.col("seen") - F.col("_rows") >= min_support
    flags = curve.join(most, keys).select(
        *keys, "score", F.struct("p", "n", "tp", "seen").alias("_curve"), "_p", "_rows", (F.col("seen") >= min_support).alias("_late"), enough.cast("long").alias("_enough"),
        *[(some & (g >= F.col("_p") * int(min(d - m, 0)) - F.col("_neg") * int(m))).alias(f"_open{i}") for i, (g, m, d) in enumerate(zip(gain, num, den))],
        *[(some & enough & (g >= F.col("_p") * int(max(d - m, 0)))).cast("long").alias(f"_held{i}") for i, (g, m, d) in enumerate(zip(gain, num, den))])
    below = running_totals(flags, keys, "score", {"_c": "_enough", **{f"_c{i}": f"_held{i}" for i in at}}, descending=False)
    asked = [F.col(f"_open{i}") & (F.col(f"_c{i}") - F.col(f"_held{i}") <= F.col("_p")) for i in at]
    asked.append(F.col("_late") & (F.col("total__c") - F.col("_c") <= F.col("_rows")))  # the first point with enough rows
    marked = below.select(*keys, "score", "_curve", F.array(*asked).alias("asked")).withColumn("_any", F.array_contains("asked", True).cast("long"))
    placed = running_totals(marked, keys, "score", {"_down": "_any"}, descending=False)
    places = cut(placed.where("_down > 0").select(*keys, "score", "_curve.*", "asked", ((F.col("total__down") - F.col("_down")) * 2 + F.col("_any")).alias("place")))
    points = places.where("place % 2 = 1")
    near = ties.join(_apart(places.select(*keys, "score", "place")), [*keys, "score"]).groupBy(*keys, "fold", "place").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    base = curve.select(*keys).distinct().withColumn("_one", F.lit(1)).join(folds.select("fold").withColumn("_one", F.lit(1)), "_one").drop("_one")  # the result has a row for each
    said = F.struct("place", "p", "n")
    zero = F.lit(0).cast("long")
    rows = near.select(*keys, "fold", zero.alias("own"), said.alias("said")).unionByName(_apart(sizes).select(*keys, "fold", "own", F.lit(None).cast(near.select(said.alias("x")).schema["x"].dataType).alias("said"))).unionByName(
        base.select(*keys, "fold", zero.alias("own"), F.lit(None).cast(near.select(said.alias("x")).schema["x"].dataType).alias("said")))
    return rows.groupBy(*keys, "fold").agg(F.sum("own").alias("own"), F.array_sort(F.collect_list("said")).alias("like")), points


def _close_thetas(like: pd.DataFrame, points: pd.DataFrame, floors, min_support: int) -> np.ndarray:
    """(folds, floors) thetas, NaN where no point holds. ``like``: lists place, p and n of each fold's rows."""
    num, den = _exact(floors)
    points = points.sort_values("place")
    score, p, n, tp, seen = (points[c].to_numpy() for c in ("score", "p", "n", "tp", "seen"))
    asked = np.array(points["asked"].tolist(), bool).reshape(len(points), len(num) + 1)
    out = np.full((len(like), len(num)), np.nan)
    step = max(1, TABLE // max(len(score), 1))
    for lo in range(0, len(like) if len(score) else 0, step):
        part = like.iloc[lo:lo + step]
        row = np.repeat(np.arange(len(part)), part["place"].map(len))
        place, own_p, own_n = (np.concatenate(part[c].to_numpy()).astype(np.int64) for c in ("place", "p", "n"))
        op, on, here_p, here_n = (np.zeros((len(part), len(score)), np.int64) for _ in range(4))
        np.add.at(op, (row, place // 2), own_p)
        np.add.at(on, (row, place // 2), own_n)
        odd = place % 2 == 1  # rows at the point, and not between it and the one above
        here_p[row[odd], place[odd] // 2], here_n[row[odd], place[odd] // 2] = own_p[odd], own_n[odd]
        t, r = tp - np.cumsum(op, axis=1), seen - np.cumsum(on, axis=1)
        rows = np.arange(len(part))
        late = (r >= min_support) & (n > here_n) & asked[:, -1]
        first, any_late = late.argmax(axis=1), late.any(axis=1)
        for i in range(len(num)):
            at = np.flatnonzero(asked[:, i])
            ok = (r[:, at] >= min_support) & (p[at] > here_p[:, at]) & (den[i] * t[:, at] >= num[i] * r[:, at])
            some = ok.any(axis=1) if len(at) else np.zeros(len(part), bool)
            out[lo + rows[some], i] = score[at[ok.shape[1] - 1 - ok[some][:, ::-1].argmax(axis=1)]] if some.any() else np.nan
            else_first = ~some & any_late & (den[i] * t[rows, first] >= num[i] * r[rows, first])
            out[lo + rows[else_first], i] = score[first[else_first]]
    return out


def held_out_thetas(ties: DataFrame, keys: list[str], folds: DataFrame, n_folds: int, floors=FLOORS, min_support: int = 10) -> DataFrame:
    """(keys, fold, n_pos, thetas): for each fold, without its rows, positives left and per floor the theta of the deepest
    point that holds it, as ``floor_thetas`` picks it on the refitted curve; null where none does.

    ``ties`` has (keys, fold, score, p, n), ``folds`` each fold once. One fold of those alike is held against the points that
    may be its answer, or refitted where these are many."""
    curve = running_totals(ties.groupBy(*keys, score_bin(F.col("score")).alias("bin"), "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), keys, "score", {"tp": "p", "seen": "n"})
    curve = cut(curve.select(*keys, "bin", "score", "p", "n", "tp", "seen"))
    every_fold, points = _alike_folds(ties, curve, keys, folds, floors, min_support)
    every_fold = cut(every_fold)
    asked_for = cut(every_fold.groupBy(*keys, "like").agg(F.min("fold").alias("fold")))
    sizes = asked_for.groupBy(*keys).agg(F.count(F.lit(1)).alias("_folds")).join(_apart(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_points"))), keys, "left").withColumn("_wide", F.coalesce(F.col("_points") > CLOSE, F.lit(False)))
    sizes = cut(sizes.drop("_points"))  # a row per key
    most = {r["_wide"]: r["most"] for r in sizes.groupBy("_wide").agg(F.max("_folds").alias("most")).collect()}
    fold_kind = dict(ties.dtypes)["fold"]
    kinds = ", ".join(f"`{k}` {t}" for k, t in ties.select(*keys).dtypes)
    blocks = max(1, -(-most.get(False, 0) // FOLD_BLOCK))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    close = asked_for.join(sizes.where("not _wide").select(*keys), keys, "left_semi").select(
        *keys, "fold", *[F.col("like")[c].alias(c) for c in ("place", "p", "n")], F.pmod(F.xxhash64("fold"), F.lit(blocks)).cast("int").alias("block"))

    def look(left, right):
        if not len(left):
            return pd.DataFrame(columns=[*keys, "fold", "thetas"])
        return left[[*keys, "fold"]].assign(thetas=list(_close_thetas(left, right, floors, min_support)))

    found = close.groupBy(*keys, "block").cogroup(_apart(points.select("*", every)).groupBy(*keys, "block")).applyInPandas(look, f"{kinds}, fold {fold_kind}, thetas array<double>")
    found = found.select(*keys, "fold", F.transform("thetas", lambda t: F.when(~F.isnan(t), t)).alias("thetas"))
    if True in most:
        wide = asked_for.join(sizes.where("_wide").select(*keys), keys, "left_semi").select(*keys, "fold")
        found = found.unionByName(_refitted(ties, curve, keys, cut(wide), most[True], floors, min_support))
    total = curve.groupBy(*keys).agg(F.sum("p").alias("_all"))
    found = cut(asked_for.join(found, [*keys, "fold"]).join(_apart(total), keys).select(*keys, "like", "_all", "thetas"))
    return every_fold.join(found, [*keys, "like"]).select(*keys, "fold", (F.col("_all") - F.col("own")).alias("n_pos"), "thetas")


def _refitted(ties: DataFrame, curve: DataFrame, keys: list[str], base: DataFrame, n_folds: int, floors, min_support: int) -> DataFrame:
    """(keys, fold, thetas) of the folds of ``base``. Cells hold the bins of one key, or the scores of one bin, and a bounded
    number of folds."""
    num, den = _exact(floors)
    blocks = max(1, -(-n_folds // FOLD_BLOCK))
    block = F.pmod(F.xxhash64("fold"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    kinds = ", ".join(f"`{k}` {t}" for k, t in ties.select(*keys).dtypes)
    fold_kind = dict(ties.dtypes)["fold"]
    ties = cut(ties.join(_apart(base), [*keys, "fold"], "left_semi").withColumn("bin", score_bin(F.col("score"))))
    gain = [F.max(F.when(F.col("p") > 0, F.col("tp") * int(d) - F.col("seen") * int(m))).alias(f"g{i}") for i, (m, d) in enumerate(zip(num, den))]
    bins = curve.groupBy(*keys, "bin").agg(F.max("seen").alias("seen_end"), F.count(F.lit(1)).alias("_scores"), *gain)
    upto = F.sum("_scores").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # some ten thousand bins at most
    bins = cut(bins.withColumn("bucket", F.floor(F.coalesce(upto, F.lit(0)) / BUCKET).cast("long")).drop("_scores"))
    bucket_of = bins.select(*keys, "bin", "bucket")
    own = ties.groupBy(*keys, "fold", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).unionByName(
        base.select(*keys, "fold", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n")))
    shape = f"{kinds}, block int, fold {fold_kind}, i int, bucket long, bin long, tp_before long, n_before long"
    group = [*keys, "block"]

    def with_key(key, names, got):
        for k, v in zip(reversed(names), reversed(key)):
            got.insert(0, k, v)
        return got

    def pick(key, left, right):
        got = _candidates(left, right, floors, min_support) if len(left) and len(right) else pd.DataFrame(columns=["fold", "i", "bucket", "bin", "tp_before", "n_before"])
        return with_key(key, group, got)

    asked = cut(own.withColumn("block", block).groupBy(*group).cogroup(_apart(bins.select("*", every)).groupBy(*group)).applyInPandas(pick, shape))
    places = [*keys, "block", "bucket"]
    needed = _apart(asked.select(*keys, "block", "bin").distinct())
    none = F.lit(None)
    held = curve.select("*", every).withColumn("fold", none.cast(fold_kind)).unionByName(
        ties.select(*keys, "bin", "score", "p", "n", none.cast("long").alias("tp"), none.cast("long").alias("seen"), block.alias("block"), "fold")).join(needed, [*keys, "block", "bin"], "left_semi").join(_apart(bucket_of), [*keys, "bin"])

    def look(key, left, right):
        got = _points(left, right, floors, min_support) if len(left) and len(right) else pd.DataFrame(columns=["fold", "i", "tp", "seen", "theta"])
        return with_key(key[:len(keys)], keys, got)

    found = asked.groupBy(*places).cogroup(_apart(held).groupBy(*places)).applyInPandas(look, f"{kinds}, fold {fold_kind}, i int, tp long, seen long, theta double")
    best = found.groupBy(*keys, "fold").agg(*[F.max(F.when(F.col("i") == i, F.struct("tp", "theta"))).alias(f"b{i}") for i in range(len(num))],
                                            F.max(F.when(F.col("i") == -1, F.struct("tp", "seen", "theta"))).alias("first"))
    theta = F.array(*[F.coalesce(F.col(f"b{i}.theta"), F.when(F.col("first.tp") * int(d) >= F.col("first.seen") * int(m), F.col("first.theta"))) for i, (m, d) in enumerate(zip(num, den))])
    return base.join(best, [*keys, "fold"], "left").select(*keys, "fold", theta.alias("thetas"))


def held_out_bars(ties: DataFrame, keys: list[str], folds: DataFrame, n_folds: int, spec: RuleSpec, floors=FLOORS) -> DataFrame:
    """(keys, species_key, fold, thetas): the bars of every fold refitted without it, one theta per floor; those for
    species without a curve have a NULL species. Guards and fallback are the spec's."""
    ties = cut(ties)
    own = held_out_thetas(ties, [*keys, "species_key"], folds, n_folds, floors, spec.min_support)
    together = cut(ties.groupBy(*keys, "fold", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    pooled = held_out_thetas(together, keys, folds, n_folds, floors, spec.min_support)
    fallback = F.array_repeat(F.lit(float(spec.default_fixed)), len(floors)) if spec.fallback == "fixed" else F.col("thetas")
    pooled = cut(pooled.select(*keys, "fold", fallback.alias("fb")))
    rows = own.join(pooled, [*keys, "fold"]).select(*keys, "species_key", "fold", F.when(
        F.col("n_pos") >= spec.min_labelled, F.zip_with("thetas", "fb", lambda t, f: F.coalesce(t, f))).otherwise(F.col("fb")).alias("thetas"))
    return rows.unionByName(pooled.select(*keys, F.lit(None).cast("string").alias("species_key"), "fold", F.col("fb").alias("thetas")))


# ------------------------------------------------------------------ counts
def _at_levels(lists, cuts: np.ndarray, add_up: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts (all, shown) of each pair at every cut, and a last column of zeros, from lists of (level, all, shown)."""
    every, shown = (np.zeros((len(lists), len(cuts) + 1), np.int64) for _ in range(2))
    for i, entries in enumerate(lists):
        if entries is not None and len(entries):
            at = np.searchsorted(cuts, [e["level"] for e in entries])
            every[i, at] = [e["n_all"] for e in entries]
            shown[i, at] = [e["n_shown"] for e in entries]
    if add_up:
        every, shown = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (every, shown))
    return every, shown


def _at_thetas(lists: str, what: str, add_up: bool):
    """Counts of a pair at each of its fold's thetas, from its list of (level, n_all, n_shown); a null theta counts nothing."""
    def one(t):
        reached = F.filter(lists, lambda e: (e["level"] >= t) if add_up else (e["level"] == t))
        return F.coalesce(F.aggregate(reached, F.lit(0).cast("long"), lambda n, e: n + e[what]), F.lit(0)).cast("int")
    return F.transform("thetas", one)


def levels(det: DataFrame, cuts: DataFrame, keys: list[str], within_s: float | None, name: str) -> DataFrame:
    """(keys, recording, species, name): per pair a list of (level, n_all, n_shown), no longer than its species has cuts.

    Without a span: detections by the greatest cut they reach. With one: the most within the span among those that reach
    the cut, for every cut."""
    g = [*keys, *PAIR, "level"]
    s = F.col("score_raw").cast("double")
    d = det.join(cuts, [*keys, "species_key"]).withColumn("reached", F.filter("cuts", lambda c: c <= s)).where("size(reached) > 0").withColumn("shown", ~F.col("implausible"))
    if within_s is None:
        n = d.withColumn("level", F.array_max("reached")).groupBy(*g).agg(F.count(F.lit(1)).alias("n_all"), F.count_if("shown").alias("n_shown"))
    else:
        each = d.select(*keys, *PAIR, "start_s", "shown", F.explode("reached").alias("level"))
        a = span_counts(each, g, within_s).groupBy(*g).agg(F.max("in_span").alias("n_all"))
        b = span_counts(each.where("shown"), g, within_s).groupBy(*g).agg(F.max("in_span").alias("n_shown"))
        n = a.join(b, g, "left").fillna(0, ["n_shown"])
    return n.groupBy(*keys, *PAIR).agg(F.array_sort(F.collect_list(F.struct("level", "n_all", "n_shown"))).alias(name))


def fold_pairs(det: DataFrame, bars: DataFrame, pairs_of: DataFrame, truth: DataFrame, label_set: DataFrame, folds: DataFrame, rule: SurveyRule, cells: Cells,
               model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, tables, held). ``assigned``: (model, fold, species, vec), vec standing for the fold's thetas. ``tables``:
    (model, species, vec, cells), the sweep cells of all recordings under these thetas. ``held``:
    (model, fold, recording, species, cls, fs, fa, cs, ca), the pairs of each fold with counts at its own thetas."""
    keys = [model]
    listed = det.select(*keys, "species_key").distinct().unionByName(truth.select(*keys, "species_key").distinct()).distinct()
    own = bars.where("species_key is not null")
    rest = listed.join(own.select(*keys, "species_key").distinct(), [*keys, "species_key"], "left_anti").join(bars.where("species_key is null").drop("species_key"), keys)
    assigned = cut(own.join(listed, [*keys, "species_key"], "left_semi").unionByName(rest.select(*own.columns)).withColumn("vec", F.xxhash64("thetas")))
    vecs = cut(assigned.groupBy(*keys, "species_key", "vec").agg(F.first("thetas").alias("thetas")))
    cuts = cut(vecs.select(*keys, "species_key", F.explode("thetas").alias("t")).where("t is not null").groupBy(*keys, "species_key").agg(F.array_sort(F.collect_set("t")).alias("cuts")))
    firm = levels(det, cuts, keys, rule.firm.within_s, "firm")
    lists = firm.withColumn("check", F.col("firm")) if rule.check.within_s == rule.firm.within_s else firm.join(levels(det, cuts, keys, rule.check.within_s, "check"), [*keys, *PAIR], "full_outer")
    uni = lists.join(truth.select(*keys, *PAIR).withColumn("a", F.lit(True)), [*keys, *PAIR], "full_outer").join(
        label_set.select("species_key").withColumn("j", F.lit(True)), "species_key", "left").join(pairs_of.select("recording_id"), "recording_id", "left_semi").join(folds, "recording_id")
    # a pair knows its own fold's thetas, so only distinct thetas have to meet what pairs there are
    uni = uni.join(_apart(assigned.select(*keys, "species_key", "fold", "vec")), [*keys, "species_key", "fold"]).join(_apart(vecs), [*keys, "species_key", "vec"])
    firm_counts, check_counts = ({k: _at_thetas(name, f"n_{k}", c.within_s is None) for k in ("shown", "all")} for name, c in (("firm", rule.firm), ("check", rule.check)))
    same = rule.check.within_s == rule.firm.within_s
    uni = uni.select(*keys, *PAIR, "fold", "firm", "check", F.when(F.col("a"), "a").when(F.col("j"), "w").otherwise("u").alias("cls"),
                     firm_counts["shown"].alias("fs"), firm_counts["all"].alias("fa"), *([] if same else [check_counts["shown"].alias("cs"), check_counts["all"].alias("ca")]))
    uni = cut(uni)
    alike = cut(uni.groupBy(*keys, "species_key", "cls", "firm", "check").agg(F.count(F.lit(1)).alias("times")))  # pairs that no thetas tell apart
    blocks = max(1, -(-(alike.groupBy(*keys, "species_key").count().agg(F.max("count")).first()[0] or 0) // RECORDING_BLOCK))
    alike = alike.withColumn("block", F.pmod(F.xxhash64("cls", "firm", "check"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    model_kind = dict(bars.dtypes)[model]
    shape = f"`{model}` {model_kind}, species_key string, vec long, cells binary"
    sums = (rule.firm.within_s is None, rule.check.within_s is None)
    added = [model, "species_key", "vec"]

    def count(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*added, "cells"])
        theta = np.array([[np.inf if t is None or t != t else t for t in row] for row in right["thetas"]], float)
        near = np.unique(theta[np.isfinite(theta)])
        fa, fs = _at_levels(left["firm"], near, sums[0])
        ca, cs = _at_levels(left["check"], near, sums[1])
        cls, times = left["cls"].to_numpy(), left["times"].to_numpy()
        out = []
        for v, own_theta in zip(right["vec"], theta):
            at = np.searchsorted(near, own_theta)  # an infinite theta meets the column of zeros
            got = cells.counts(cls, fs[:, at], fa[:, at], cs[:, at], ca[:, at], times)
            out.append((key[0], key[1], v, got.astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=[*added, "cells"])

    done = alike.groupBy(model, "species_key", "block").cogroup(_apart(vecs.select("*", every)).groupBy(model, "species_key", "block")).applyInPandas(count, shape)

    def add_up(key, parts):
        total = sum(np.frombuffer(c, np.int32) for c in parts["cells"])
        return pd.DataFrame([(*key, total.tobytes())], columns=[*added, "cells"])

    tables = done.groupBy(*added).applyInPandas(add_up, shape)
    held = uni.select(model, "fold", *PAIR, "cls", "fs", "fa", *([F.col("fs").alias("cs"), F.col("fa").alias("ca")] if same else ["cs", "ca"]))
    return assigned.select(model, "fold", "species_key", "vec"), cut(tables), held


# ------------------------------------------------------------------ choice
def _statistics(t: np.ndarray, n: np.ndarray, hours: np.ndarray) -> dict[str, np.ndarray]:
    fr, fw, fu, cr, cw, cu, hid, missed = t
    annotated = fr + cr + missed + hid
    with np.errstate(divide="ignore", invalid="ignore"):
        d = lambda a, b: np.where(b > 0, a / b, np.nan)
        return {"firm_precision": d(fr, fr + fw), "recall_reviewed": d(fr + cr, annotated), "firm_recall": d(fr, annotated), "checks_per_recording": (cr + cw + cu) / np.maximum(n, 1),
                "checks_per_hour": d(cr + cw + cu, hours), "check_yield": d(cr, cr + cw), "firm_errors_per_recording": fw / np.maximum(n, 1)}


def _own_cells(at: np.ndarray, cls: np.ndarray, counts: list[np.ndarray], cells: Cells, valid: np.ndarray, n_folds: int) -> np.ndarray:
    """(outcomes, folds, cells): what ``Cells.counts`` says of each fold's pairs. ``at``: their folds, in rising order."""
    fs, fa, cs, ca = counts
    firm_at = np.array([cells.bars.index(float(f)) for f in cells.floors])[valid[:, 0]]
    check_at = np.array([cells.bars.index(float(c)) for c in cells.check_floors])[valid[:, 2]]
    k = np.array(cells.ks)[valid[:, 1]]
    least = np.minimum(cells.check_k, k)
    firm = fs[:, firm_at] >= k
    check = ~firm & (cs[:, check_at] >= least)
    unseen = ~((fa[:, firm_at] >= k) | (ca[:, check_at] >= least))
    hid = (~firm & ~check).astype(np.int64) - unseen
    out = np.zeros((len(OUT), n_folds, len(valid)), np.int64)
    for kind, made in {"a": {0: firm, 3: check, 6: hid, 7: unseen}, "w": {1: firm, 4: check}, "u": {2: firm, 5: check}}.items():
        own = cls == kind
        if own.any():
            which, start = np.unique(at[own], return_index=True)
            for o, x in made.items():
                out[o, which] = np.add.reduceat(x[own].astype(np.int64), start, axis=0)
    return out


def _bounds(t: np.ndarray, most: dict[str, int], n: tuple[float, float]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(least, most) of each statistic that limits or aims name, when up to ``most`` pairs of each class are taken out of the
    totals ``t`` of (outcomes, folds, cells) and ``n`` recordings are left. One that may be undefined has no bounds, one that
    is undefined whatever is taken out has none above."""
    fr, fw, _, cr, cw, cu, hid, missed = t
    less = lambda x, k: np.maximum(x - k, 0)
    a, w, u = (most.get(k, 0) for k in "awu")
    checks, annotated = cr + cw + cu, fr + cr + missed + hid

    def share(low, high, below_low, below_high):
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.where(below_low > 0, low / below_high, -np.inf), np.where(below_low > 0, high / below_low, np.where(below_high > 0, np.inf, -np.inf)))
    with np.errstate(divide="ignore", invalid="ignore"):
        low = np.where(less(fr, a) + less(fw, w) > 0, less(fr, a) / (less(fr, a) + fw), -np.inf)
        high = np.where(less(fr, a) + less(fw, w) > 0, fr / (fr + less(fw, w)), np.where(fr + fw > 0, np.inf, -np.inf))
    return {"firm_precision": (low, high), "recall_reviewed": share(less(fr + cr, a), fr + cr, less(annotated, a), annotated),
            "firm_recall": share(less(fr, a), fr, less(annotated, a), annotated),
            "checks_per_recording": (less(checks, a + w + u) / max(n[1], 1), checks / max(n[0], 1))}


def _may_be_chosen(bounds: list[dict], there: list[np.ndarray], cons: Constraints, n_models: int) -> np.ndarray:
    """Cells that may be the best of some fold, for one model or for all of them; ``there``: folds that a model has."""
    aim, sign = ORDER[cons.objective][0].lstrip("-"), -1 if ORDER[cons.objective][0][0] == "-" else 1

    def left(can, sure, low, high):
        least = np.where(sure, low, -np.inf).max(axis=1, keepdims=True)
        return can & (high >= least)
    keep, each = False, []
    for b, here in zip(bounds, there):
        can, sure = (np.repeat(here[:, None], b[aim][0].shape[1], axis=1) for _ in range(2))
        for c, side, v in limits(cons):
            low, high = b[c]
            can, sure = (can & (high >= v), sure & (low >= v)) if side == "least" else (can & (low <= v), sure & (high <= v))
        low, high = b[aim] if sign > 0 else (-b[aim][1], -b[aim][0])
        sure = sure & np.isfinite(low) & np.isfinite(high)
        each.append((can, sure, low, high))
        keep = keep | left(can, sure, low, high).any(axis=0)
    if len(each) == n_models:
        can, sure = (np.logical_and.reduce([e[i] for e in each]) for i in range(2))
        clear = np.logical_and.reduce([np.isfinite(e[2]) & np.isfinite(e[3]) for e in each])  # a mean leaves out what is undefined
        low, high = (sum(np.where(clear, e[i], 0) for e in each) / len(each) for i in (2, 3))
        keep = keep | left(can, sure, np.where(clear, low, -np.inf), np.where(clear, high, np.inf)).any(axis=0)
    return keep


def choose(folds: pd.DataFrame, tables: pd.DataFrame, cells: Cells, cons: Constraints, n_models: int, model: str) -> pd.DataFrame:
    """(model or null, fold, check_floor, floor, k, statistics): each fold's best cell per model, and the best one that
    all models share, where there is one, out of the cells that their totals leave open. ``folds``: a row per (model, fold, species, pair of the fold) with vec, and
    with counts and class where there is a pair; n and hours of the other folds. Some folds are looked at together."""
    valid = np.array(cells.valid())
    shape = (len(OUT), len(cells.floors), len(cells.ks), len(cells.check_floors))
    whole = {(m, sp, v): np.frombuffer(c, np.int32).reshape(shape)[:, valid[:, 0], valid[:, 1], valid[:, 2]].astype(np.int64)
             for m, sp, v, c in zip(tables[model], tables["species_key"], tables["vec"], tables["cells"])}
    every_cell = {"floor": np.array(cells.floors)[valid[:, 0]], "k": np.array(cells.ks, float)[valid[:, 1]], "check_floor": np.array(cells.check_floors)[valid[:, 2]]}
    none = np.zeros((len(OUT), len(valid)), np.int64)
    summed: dict = {}

    def all_pairs(m, named: tuple) -> np.ndarray:
        """The cells of all recordings under one choice of thetas for every species."""
        if (m, named) not in summed:
            summed[m, named] = sum((whole[m, sp, v] for sp, v in named if (m, sp, v) in whole), none)
        return summed[m, named]

    def best(st: dict, ok: np.ndarray, cell: dict) -> tuple[np.ndarray, np.ndarray]:
        """(folds, cells): the best cell of each fold that has one; the first one among equals."""
        given, alive = {**st, **cell}, ok.copy()
        for name in ORDER[cons.objective]:
            x = -given[name[1:]] if name[0] == "-" else given[name]
            x = np.where(alive & ~np.isnan(x), x, -np.inf)
            alive &= x == x.max(axis=1, keepdims=True)
        some = np.flatnonzero(ok.any(axis=1))
        return some, alive[some].argmax(axis=1)

    def kept(st: dict) -> np.ndarray:
        ok = np.ones(st[STATS[0]].shape, bool)
        for c, side, v in limits(cons):
            with np.errstate(invalid="ignore"):
                ok &= (st[c] >= v) if side == "least" else (st[c] <= v)
        return ok

    def said(m, names, st: dict, at: tuple[np.ndarray, np.ndarray], cell: dict) -> pd.DataFrame:
        f, c = at
        return pd.DataFrame({model: np.full(len(f), m, object), "fold": names[f], "check_floor": cell["check_floor"][c], "floor": cell["floor"][c], "k": cell["k"][c].astype(int),
                             **{s: st[s][f, c] for s in STATS}})

    out = []
    code, ids = pd.factorize(folds["fold"])
    folds = folds.assign(_at=code)
    sets: list[dict] = [{} for _ in ids]  # per fold and model the thetas of each species
    for f, m, sp, v in zip(code, folds[model], folds["species_key"], folds["vec"]):
        sets[f].setdefault(m, set()).add((sp, v))
    seen: dict = {}
    combos = np.array([seen.setdefault(tuple(sorted((m, tuple(sorted(x))) for m, x in s.items())), len(seen)) for s in sets], np.int64)
    kinds = list(seen)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(combos, kind="stable")] = np.arange(len(ids))  # folds with the same thetas are looked at together
    ids, combos = np.asarray(ids)[np.argsort(rank)], np.sort(combos, kind="stable")
    folds["_at"] = rank[code]
    folds = folds.sort_values("_at", kind="stable")
    for lo in range(0, len(ids), TOGETHER):
        names = ids[lo:lo + TOGETHER]
        rows = folds.iloc[slice(*np.searchsorted(folds["_at"], [lo, lo + len(names)]))]
        which, of = np.unique(combos[lo:lo + len(names)], return_inverse=True)
        parts, bounds, there = [], [], []
        for m, part in rows.groupby(model, sort=False):
            at = part["_at"].to_numpy() - lo
            here, first = np.unique(at, return_index=True)
            n, hours = np.full((len(names), 1), np.nan), np.full((len(names), 1), np.nan)
            n[here, 0], hours[here, 0] = part["n"].to_numpy(float)[first], part["hours"].to_numpy(float)[first]
            named = [dict(kinds[w]).get(m) for w in which]
            t = np.stack([none if x is None else all_pairs(m, x) for x in named], axis=1)
            own = part["cls"].notna().to_numpy()
            most = pd.crosstab(at[own], part["cls"].to_numpy()[own]).max().to_dict() if own.any() else {}
            parts.append((m, at[own], part[own], t, n, hours))
            bounds.append(_bounds(t, most, (np.nanmin(n), np.nanmax(n))))
            there.append(np.array([x is not None for x in named]))
        may = np.flatnonzero(_may_be_chosen(bounds, there, cons, n_models))
        may = may if len(may) else np.zeros(1, np.int64)
        cell = {c: x[may] for c, x in every_cell.items()}
        every, fine = [], np.zeros((len(names), len(may)), int)
        for m, at, pairs, t, n, hours in parts:
            t = t[:, :, may][:, of]
            if len(pairs):
                t -= _own_cells(at, pairs["cls"].to_numpy(), [np.concatenate(pairs[c].to_numpy()).reshape(len(pairs), -1) for c in ("fs", "fa", "cs", "ca")], cells, valid[may], len(names))
            st = _statistics(t.astype(float), n, hours)
            ok = kept(st)
            absent = np.isnan(n[:, 0])
            ok[absent] = False
            for s in STATS:
                st[s][absent] = np.nan
            fine += ok
            every.append(st)
            out.append(said(m, names, st, best(st, ok, cell), cell))
        mean = {}
        for s in STATS:
            x = np.array([st[s] for st in every])
            some = ~np.isnan(x)
            mean[s] = np.where(some.any(axis=0), np.where(some, x, 0).sum(axis=0) / np.maximum(some.sum(axis=0), 1), np.nan)
        out.append(said(None, names, mean, best(mean, fine == n_models, cell), cell))
    return pd.concat(out, ignore_index=True)[[model, "fold", "check_floor", "floor", "k", *STATS]]


def held_out(aligned: DataFrame, det: DataFrame, folds: DataFrame, rule: SurveyRule, spec: RuleSpec, truth: DataFrame, recordings: DataFrame, cons: Constraints, label_set: DataFrame,
             models: list[str], model: str = "run_id", floors=FIRM_FLOORS, ks=KS, check_floors=FLOORS) -> dict[str, DataFrame]:
    """Leave each fold out: refit bars, sweep, choose (own and shared), score the held-out recordings only.

    ``folds`` gives every recording its fold; with one fold per recording this is leave-one-recording-out. ``truth``:
    (recording, species); ``recordings``: (recording, hours). Returns bars, the picks (own, shared) and the held-out
    per-recording counts of both (held_own, held_shared). Folds for which no cell keeps the limits list nothing."""
    cells = Cells(tuple(map(float, floors)), tuple(ks), tuple(map(float, check_floors)), rule.check.k)
    by_model = lambda df: df.withColumn(model, F.explode(F.array(*[F.lit(m) for m in models])))
    truth = by_model(truth)
    per_fold = cut(recordings.join(folds, "recording_id").groupBy("fold").agg(F.count(F.lit(1)).alias("own_n"), F.sum("hours").alias("own_hours")))
    n_folds, n_all, hours_all = per_fold.agg(F.count(F.lit(1)), F.sum("own_n"), F.sum("own_hours")).first()
    ties = fold_ties(aligned, [model, "species_key"], folds)
    bars = cut(held_out_bars(ties, [model], spread(per_fold.select("fold"), "fold"), n_folds, spec, cells.bars))
    assigned, tables, held = fold_pairs(det, bars, recordings, truth, label_set, folds, rule, cells, model)
    block = F.pmod(F.xxhash64("fold"), F.lit(max(1, -(-n_folds // CHOICE_BLOCK)))).cast("int").alias("block")
    left = assigned.join(held.drop("recording_id"), [model, "fold", "species_key"], "left").join(per_fold, "fold").select(
        block, model, "fold", "species_key", "vec", "cls", "fs", "fa", "cs", "ca", (F.lit(n_all or 0) - F.col("own_n")).alias("n"), (F.lit(hours_all or 0.0) - F.col("own_hours")).alias("hours"))
    right = assigned.select(block, model, "species_key", "vec").distinct().join(tables, [model, "species_key", "vec"]).select("block", model, "species_key", "vec", "cells")
    kinds = dict(assigned.dtypes)
    shape = f"`{model}` {kinds[model]}, fold {kinds['fold']}, check_floor double, floor double, k int, " + ", ".join(f"{s} double" for s in STATS)

    def pick(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=[model, "fold", "check_floor", "floor", "k", *STATS])
        return choose(a, b, cells, cons, len(models), model)

    picks = cut(left.groupBy("block").cogroup(_apart(right).groupBy("block")).applyInPandas(pick, shape))
    own, shared = picks.where(F.col(model).isNotNull()), picks.where(F.col(model).isNull()).drop(model)
    listed = F.array(*[F.lit(b) for b in cells.bars])

    def score_held(p: DataFrame) -> DataFrame:
        on = [model, "fold"] if model in p.columns else ["fold"]
        d = held.join(p.select(*on, "floor", "check_floor", "k"), on, "left")
        at = lambda c, floor: F.coalesce(F.element_at(c, F.array_position(listed, F.col(floor)).cast("int")), F.lit(0))
        ck = F.least(F.lit(rule.check.k), F.col("k"))
        tier = lambda f, c: F.when(at(f, "floor") >= F.col("k"), "firm").when(at(c, "check_floor") >= ck, "check").otherwise("not found")
        rows = d.select(model, *PAIR, tier("fs", "cs").alias("tier"), tier("fa", "ca").alias("tier_all"), (F.col("cls") == "a").alias("annotated"), (F.col("cls") != "u").alias("judged"))
        return per_recording(outcome_of(rows), by_model(recordings.select("recording_id", "hours")), [model])

    return {"bars": bars, "own": own, "shared": shared, "held_own": score_held(own), "held_shared": score_held(shared)}


__all__ = ["COL", "fold_ties", "held_out", "held_out_bars", "held_out_thetas"]
