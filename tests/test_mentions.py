"""The automaton over names against regular expressions, one name at a time."""

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspark.operators import mentions, search


def by_hand(names, text):
    found = {n: len(regex.findall(rf"(?<![\p{{Alphabetic}}\p{{N}}_]){regex.escape(n)}(?![\p{{Alphabetic}}\p{{N}}_])", text)) for n in names}
    return {n: k for n, k in found.items() if k}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab é_.1", min_size=1, max_size=5), max_size=8, unique=True), st.text("ab é_.1", max_size=60))
def test_counts(names, text):
    assert mentions.Finder(names).counts(text) == by_hand(names, text)


def test_names_within_names_and_across_shards(notes):
    table = notes(
        ("Plan.md", "Meeting notes May, meeting notes and the meeting."),
        ("x/Meeting notes.md", "See the plan. Plans are no plan, Plan_b neither; [[plan]] is."),
        ("Meeting notes May.md", "plan plan [[other]] (plan)"),
        ("y/Plan.md", "nothing but C++ and .net"),
        ("C++.md", "the plan"),
        (".net.md", "C++."),
        ("ab.md", "ab ab"),
    )
    want = {
        ("Plan.md", "x/Meeting notes.md", 2),
        ("Plan.md", "Meeting notes May.md", 1),
        ("Meeting notes May.md", "Plan.md", 3),
        ("Meeting notes May.md", "y/Plan.md", 3),
        ("y/Plan.md", "C++.md", 1),
        ("y/Plan.md", ".net.md", 1),
        ("C++.md", "Plan.md", 1),
        ("C++.md", "y/Plan.md", 1),
        (".net.md", "C++.md", 1),
    }
    for shard in (mentions.SHARD, 20, 1):
        assert {(r["path"], r["dst"], r["count"]) for r in search.all_mentions(table, shard).collect()} == want
    plan = search.all_mentions(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") + plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2  # the texts, and the names


def test_no_names(notes):
    assert search.all_mentions(notes(("a.md", "a b"))).count() == 0
