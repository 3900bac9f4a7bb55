"""The most alike texts of a group against difflib on all pairs."""

from __future__ import annotations

import difflib
import random

import pytest

from veldgraph import registry
from veldgraph.functions import parsers
from veldgraph.operators import ratios

rng = random.Random(11)
WORDS = ["".join(rng.choice("eeetaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(80)]


def _said(n: int) -> str:
    return " ".join(rng.choice(WORDS).title() if rng.random() < 0.1 else rng.choice(WORDS) for _ in range(n))


def _changed(text: str, share: float) -> str:
    """Letters in all words are others, so no three words in a row are the same."""
    return "".join(rng.choice("xyzE, ") if rng.random() < share else c for c in text)


def _texts() -> list[str | None]:
    base = [_said(n) for n in (1, 4, 12, 30, 45, 60, 200)]
    found = [*base, *(_changed(b, s) for b in base for s in (0.04, 0.12, 0.2, 0.35)), *(b[len(b) // 3 :] + " " + b[: len(b) // 3] for b in base)]
    plain = ["e" * 700, "e" * 500 + "t" * 300, "eta" * 250 + "Q", "e" * 390 + "Q" + "t" * 300, "", "", None, "\U0001f600é" * 150, "가나다라마바사 " * 40]
    return [*found, *plain, base[4], base[4], base[4], base[4], base[4], base[4], base[4]]


def _best(docs: list[tuple], asked, most: int) -> dict:  # noqa: ANN001
    want = {}
    for i, text, group in docs:
        if not asked(i) or text is None:
            continue
        scores = [(-difflib.SequenceMatcher(None, text, other).ratio(), k) for k, other, g in docs if g == group and k != i and other is not None]
        for rank, (score, k) in enumerate(sorted(s for s in scores if -s[0] >= 0.5)[:most], 1):
            want[i, rank] = (k, round(-score, 6))
    return want


def test_similar_documents_of_the_whole_table(spark, tmp_path):
    """Also those that share no run of words, of no language, copies and texts in which all letters are frequent."""
    texts = _texts()
    docs = [(25 * i, t, (None, "a")[i % 5 > 0]) for i, t in enumerate(texts * 2)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["rank"]): (r["other_id"], r["ratio"]) for r in registry.queries()["s_similar_docs"](spark, str(tmp_path)).collect()}
    want = _best(docs, lambda i: i % 50 == 0, 5)
    assert got == want
    assert len(want) > 150


def test_cells_of_any_size_give_the_same(spark, monkeypatch):
    docs = [(i, t, "g") for i, t in enumerate(_texts())]
    rows = spark.createDataFrame(docs, "k long, text string, g string")
    for cell, asked in ((2_000, 2_000), (16_000, 500)):
        monkeypatch.setattr(ratios, "CELL_CHARS", cell)
        monkeypatch.setattr(ratios, "ASKED_CHARS", asked)
        got = {(r["k"], r["rank"]): (r["other_id"], round(r["ratio"], 6)) for r in ratios.most_alike(rows, "k", "g", rows["k"] % 3 == 0, 0.5, 3).collect()}
        assert got == _best(docs, lambda i: i % 3 == 0, 3)


@pytest.fixture(scope="module")
def every():  # noqa: ANN201
    texts = [(i, t) for i, t in enumerate(_texts()[:-6]) if t is not None] + [(1000 + i, _said(rng.randint(60, 120))) for i in range(40)]
    return texts, {(a, b): difflib.SequenceMatcher(None, x, y).ratio() for a, x in texts for b, y in texts}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_few_pairs_are_matched_and_none_is_lost(monkeypatch, every, least):
    texts, ratio = every
    matched, whole = [], ratios.ratio_from
    monkeypatch.setattr(ratios, "ratio_from", lambda m, x: matched.append(m) or whole(m, x))
    got = {(a, b): r for found in ratios.matches(texts, texts, least) for a, b, r in found}
    assert got == {k: v for k, v in ratio.items() if v >= least}
    if least >= 0.5:
        assert len(matched) < len(got) + len(ratio) / 20


def test_blocks_are_those_of_difflib():
    texts = [t for t in _texts() if t]
    for b in texts:
        plain, matcher = difflib.SequenceMatcher(None, "", b), parsers.AnchorMatcher(b)
        for a in rng.sample(texts, 12):
            plain.set_seq1(a)
            matcher.set_seq1(a)
            assert matcher.find_longest_match(0, len(a), 0, len(b)) == tuple(plain.find_longest_match(0, len(a), 0, len(b)))
            assert parsers.ratio_from(matcher, 0.0) == plain.ratio()


def test_no_text_is_written_for_a_pair(spark, monkeypatch):
    """Texts that are all alike make thousands of pairs; each text is dealt once, and each asked one once more."""
    base = _said(25)[:150]
    rows = spark.createDataFrame([(i, _changed(base, 0.02) + str(i), "g") for i in range(200)], "k long, text string, g string")
    found, dealt = ratios._within_cells, []
    monkeypatch.setattr(ratios, "_within_cells", lambda docs, texts, mine, least: dealt.append(texts.count() + mine.count()) or found(docs, texts, mine, least))
    assert ratios.most_alike(rows, "k", "g", rows["k"] % 10 == 0, 0.5, 250).count() == 20 * 199
    assert dealt == [220]
