"""Verbatim items whatever stands before them, placeholder-heavy items, conflicting slots."""

from test_decontaminate import ITEM, leaks


def test_the_word_before_does_not_hide_an_item(spark):
    eight, four, named = "Which river flows through the old market town?", "Where do owls sleep?", "Alice gives 5 pears to her old neighbour"
    got = leaks(spark, [f"Question: {eight}", f"Title line\n{four}", f"Q: {named.replace('Alice', 'Carol').replace('5', '7')}", "Question: Which river flows through the new market town?"], [eight, four, named])
    assert set(got) == {(0, 0), (1, 1), (2, 2)}
    assert got[0, 0]["share"] == 1 and got[0, 0]["exact"] and not got[2, 2]["exact"]


def test_items_of_placeholders_are_found_verbatim(spark):
    item = "12 km 13 km 14 km Alice Bob Carol 15 cm"
    got = leaks(spark, [f"so {item} then", item.replace("12", "99").replace("Bob", "Dave"), item.lower()], [item])
    assert set(got) == {(0, 0), (2, 0)}


def test_a_conflict_costs_only_the_windows_that_hold_it(spark):
    item = "We know that somewhere behind the old mill on the quiet hill above the river there were 5 apples and 5 pears"
    got = leaks(spark, [item.replace("5 apples", "3 apples").replace("5 pears", "7 pears")], [item])
    assert set(got) == {(0, 0)}
    assert leaks(spark, [ITEM.replace("12", "31", 1)], [ITEM]) == {}
