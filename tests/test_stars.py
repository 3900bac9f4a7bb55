"""Stars join what all pairs join; labels within labels are found whatever their length."""

from __future__ import annotations

from veldgraph.operators import joins

ROWS = [
    (1, "암진단비", "x", "d1"), (2, "암진단비", "x", "d1"), (3, "암진단비", "x", "d2"), (4, "암진단비", "y", "d1"), (5, "Cancer", "y", "d3"), (6, "cancer cover", "y", "d3"),
    (7, "a cancer cover here", None, "d4"), (8, None, "x", "d1"), (9, "abc", "z", "d5"), (10, "abcabcabc", "z", "d5"), (11, "CANCER", "w", None), (12, "암진단비", "y", "d1"), (13, "", "z", "d1"),
]
SCHEMA = "id long, label string, type string, doc string"


def _groups(edges: set, ids: list) -> set:
    group = {i: {i} for i in ids}
    for a, b in edges:
        both = group[a] | group[b]
        for i in both:
            group[i] = both
    return {frozenset(g) for g in group.values()}


def _edges(df) -> set:  # noqa: ANN001
    rows = [(r["src"], r["dst"]) for r in df.collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows)
    return set(rows)


def test_stars_connect_what_pairs_connect(spark):  # noqa: ANN001
    ids, df = [r[0] for r in ROWS], spark.createDataFrame(ROWS, SCHEMA)
    same = {(a[0], b[0]) for a in ROWS for b in ROWS if a[0] < b[0] and a[2] and a[2] == b[2]}
    found = _edges(joins.stars(df, ["type"]))
    assert found <= same and _groups(found, ids) == _groups(same, ids)
    apart = {(a[0], b[0]) for a in ROWS for b in ROWS if a[0] < b[0] and a[1] is not None and a[2] and a[1:3] == b[1:3] and a[3] and b[3] and a[3] != b[3]}
    found = _edges(joins.stars_across(df, ["label", "type"], "doc"))
    assert found <= apart and _groups(found, ids) == _groups(apart, ids) and found


def test_labels_within_labels(spark):  # noqa: ANN001
    first: dict[str, int] = {}
    for i, label, _, _ in ROWS:
        if label and len(label) > 3:
            first.setdefault(label.lower(), i)
    want = {tuple(sorted((first[x], first[y]))) for x in first for y in first if x != y and y in x}
    assert _edges(joins.containing(spark.createDataFrame(ROWS, SCHEMA), "label")) == want == {(5, 6), (5, 7), (6, 7)}
    assert joins.containing(spark.createDataFrame([], SCHEMA), "label").count() == joins.stars(spark.createDataFrame([], SCHEMA), ["doc"]).count() == 0
