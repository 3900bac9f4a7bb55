"""Parsers that need places in the text: amounts, periods, legal structure, HTML, similarity and diffs. Small Python helpers run over Arrow batches."""

from __future__ import annotations

import bisect
import difflib
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of amounts in documents, longest forms first, with the worth of each group.
NUMBER = r"(\d+(?:,\d{3})*)"
AMOUNTS = [
    (NUMBER + r"\s*억\s*" + NUMBER + r"\s*천\s*" + NUMBER + r"\s*만\s*원?", (100_000_000, 10_000_000, 10_000)),
    (NUMBER + r"\s*억\s*" + NUMBER + r"\s*천만\s*원?", (100_000_000, 10_000_000)),
    (NUMBER + r"\s*억\s*" + NUMBER + r"\s*백만\s*원?", (100_000_000, 1_000_000)),
    (NUMBER + r"\s*억\s*" + NUMBER + r"\s*만\s*원?", (100_000_000, 10_000)),
    (NUMBER + r"\s*억\s*원?", (100_000_000,)),
    (NUMBER + r"\s*천만\s*원?", (10_000_000,)),
    (NUMBER + r"\s*백만\s*원?", (1_000_000,)),
    (NUMBER + r"\s*만\s*원?", (10_000,)),
    (NUMBER + r"\s*천\s*원?", (1_000,)),
    (NUMBER + r"\s*원", (1,)),
]
# The patterns of the extraction by spans, which ask for the unit.
SPAN_NUMBER = r"(\d+(?:,\d+)?)"
SPAN_AMOUNTS = [
    (SPAN_NUMBER + r"\s*억\s*" + SPAN_NUMBER + r"\s*만\s*원", (100_000_000, 10_000)),
    (SPAN_NUMBER + r"\s*억\s*원", (100_000_000,)),
    (SPAN_NUMBER + r"\s*천\s*만\s*원", (10_000_000,)),
    (SPAN_NUMBER + r"\s*만\s*원", (10_000,)),
    (SPAN_NUMBER + r"\s*천\s*원", (1_000,)),
    (SPAN_NUMBER + r"\s*원", (1,)),
]
PERIODS = [(r"([0-9]+)\s*년", 365), (r"([0-9]+)\s*개월", 30), (r"([0-9]+)\s*주", 7), (r"([0-9]+)\s*일", 1)]
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
# Words that begin an exception.
EXCEPTIONS = ("다만", "단서", "제외하고", "제외한", "단,")


def mapped(df: DataFrame, keep: list[str], column: str, schema: str, parse: Callable[[str], list[tuple]]) -> DataFrame:
    """The columns ``keep`` with each tuple that ``parse`` makes of a text, one row for each. A null text is an empty one."""
    names = [f.strip().split()[0] for f in schema.split(", ")]
    fields = [f for f in df.schema.fields if f.name in keep]
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                index, rows = [], []
                for i, text in enumerate(part.column("parsed_").to_pylist()):
                    for row in parse(text or ""):
                        index.append(i)
                        rows.append(row)
                taken = [part.column(f.name).take(pa.array(index, pa.int64())) for f in fields]
                made = [pa.array([r[k] for r in rows], types[k]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*taken, *made], names=[*(f.name for f in fields), *names])

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[f.strip().split()[1]] for f in schema.split(", ")]
    return df.select(*[F.col(f.name) for f in fields], F.col(column).alias("parsed_")).mapInArrow(run, out_schema)


def _number(text: str) -> int:
    return int(text.replace(",", "") or 0)


def amounts(text: str) -> list[tuple]:
    """(value, place, text): longer forms first; a place that one has taken begins no other."""
    found: dict[int, tuple] = {}
    for pattern, worth in AMOUNTS:
        for m in re.finditer(pattern, text):
            if m.start() not in found:
                found[m.start()] = (sum(_number(g) * w for g, w in zip(m.groups(), worth, strict=True)), m.start(), m[0])
    return [found[k] for k in sorted(found)]


def amounts_by_span(text: str) -> list[tuple]:
    """Amounts with their unit; a match that overlaps one of an earlier form is left out."""
    found: list[tuple[int, int, tuple]] = []
    for pattern, worth in SPAN_AMOUNTS:
        for m in re.finditer(pattern, text):
            if all(m.end() <= a or b <= m.start() for a, b, _ in found):
                found.append((m.start(), m.end(), (sum(_number(g) * w for g, w in zip(m.groups(), worth, strict=True)), m.start(), m[0])))
    return [row for *_, row in sorted(found, key=lambda x: x[0])]


def periods(text: str) -> list[tuple]:
    """(days, place, text), one for each place."""
    found: dict[int, tuple] = {}
    for pattern, days in PERIODS:
        for m in re.finditer(pattern, text):
            found.setdefault(m.start(), (int(m[1]) * days, m.start(), m[0]))
    return [found[k] for k in sorted(found)]


def legal_structure(text: str) -> list[tuple]:
    """(article, title, paragraph, text, has_exception): articles 제N조 [title], paragraphs by circled numbers, the whole body as paragraph 0 if there is none."""
    heads = list(re.finditer(r"제\s*([0-9]+)\s*조\s*(?:[\[(（【]([^\])）】]*)[\])）】])?", text))
    rows = []
    for i, head in enumerate(heads):
        body = text[head.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)]
        marks = list(re.finditer(f"[{CIRCLED}]", body))
        parts = [(0, body)] if not marks else [(CIRCLED.index(m[0]) + 1, body[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(body)]) for k, m in enumerate(marks)]
        for number, part in parts:
            rows.append((int(head[1]), (head[2] or "").strip(), number, part.strip(), any(e in part for e in EXCEPTIONS)))
    return rows


def legal_lines(text: str) -> list[tuple]:
    """(article, title, body): articles that begin a line; a text without any is one body, number 0."""
    heads = list(re.finditer(r"(?m)^\s*제\s*([0-9]+)\s*조\s*(?:[\[(]([^\])]*)[\])])?", text))
    if not heads:
        return [(0, "본문", text.strip())] if text.strip() else []
    ends = [h.start() for h in heads[1:]] + [len(text)]
    return [(int(h[1]), (h[2] or "").strip(), text[h.end() : end].strip()) for h, end in zip(heads, ends, strict=True)]


def titled_articles(text: str) -> list[tuple]:
    """(article, title, paragraphs): articles with a title in parentheses, paragraphs between blank lines."""
    heads = list(re.finditer(r"제\s*([0-9]+)\s*조\s*\(([^)]*)\)", text))
    ends = [h.start() for h in heads[1:]] + [len(text)] * bool(heads)
    return [(int(h[1]), h[2].strip(), sum(bool(p.strip()) for p in re.split(r"\n\s*\n", text[h.end() : end]))) for h, end in zip(heads, ends, strict=True)]


def exceptions(text: str) -> list[tuple]:
    """(place, keyword) in order."""
    return sorted((m.start(), k) for k in EXCEPTIONS for m in re.finditer(re.escape(k), text))


# The patterns of each type of entity. A pattern's first group is the label, or the whole match if it has none.
ENTITIES = {
    "coverage_item": [r"([가-힣]{2,10})\s*보장", r"([가-힣]{2,10})\s*담보", r"([가-힣]{2,10})\s*급부", r"([가-힣]{2,10})\s*보험금", r"(암|질병|상해|사망|후유장해|입원|수술|통원)\s*[보담급]"],
    "benefit_amount": [r"([\d,]+원|[\d,]+만원|[\d,]+억원)", r"보험금\s*([\d,]+원)", r"급부금\s*([\d,]+원)", r"([\d,]+)%\s*지급"],
    "payment_condition": [r"(진단\s*확정\s*시|사망\s*시|발생\s*시)\s*지급", r"([가-힣\s]+)\s*경우\s*지급", r"지급사유\s*:\s*([^\.]+)", r"다음\s*각\s*호의\s*([^\.]+)\s*지급"],
    "exclusion": [r"보장하지\s*[않아아니]", r"면책\s*기간", r"지급\s*[불부]\s*가", r"제외\s*[됩되]", r"([가-힣\s]+)\s*경우에는\s*[보지않]", r"다음\s*각\s*호의\s*경우\s*[보지않]"],
    "deductible": [r"자기부담금\s*([\d,]+원)", r"본인부담금\s*([\d,]+원)", r"공제금액\s*([\d,]+원)", r"([\d,]+원)\s*공제"],
    "rider": [r"([가-힣]{2,15})\s*특약", r"특약\s*:\s*([가-힣]{2,15})"],
    "eligibility": [r"가입\s*연령\s*:\s*([^\.]+)", r"(만\s*[\d]+세\s*~\s*만\s*[\d]+세)", r"가입\s*조건\s*:\s*([^\.]+)", r"피보험자\s*자격\s*:\s*([^\.]+)"],
    "article": [r"제\s*([\d]+)\s*조", r"제\s*([\d]+)\s*항", r"제\s*([\d]+)\s*호", r"조항\s*([\d]+)"],
    "term": [r"(피보험자|보험수익자|보험계약자|보험료|보험기간)", r"(보험가입금액|책임준비금|해약환급금)", r"(진단확정|후유장해|상해|질병|암)"],
    "period": [r"([\d]+일|[\d]+개월|[\d]+년)", r"보험기간\s*:\s*([^\.]+)", r"납입기간\s*:\s*([^\.]+)", r"면책기간\s*:\s*([^\.]+)"],
}
LEAST_LABEL, MOST_LABEL, AROUND = 2, 50, 50


def entities(text: str) -> list[tuple]:
    """(type, label, context): each label of 2 to 50 characters once a type, with what stands around its first place."""
    rows = []
    for kind, patterns in ENTITIES.items():
        seen: set[str] = set()
        for m in (m for p in patterns for m in re.finditer(p, text)):
            label = (m[1] if m.re.groups else m[0]).strip()
            if LEAST_LABEL <= len(label) <= MOST_LABEL and label not in seen:
                seen.add(label)
                rows.append((kind, label, text[max(0, m.start() - AROUND) : m.end() + AROUND].strip()))
    return rows


def semantic_chunks(text: str) -> list[tuple]:
    """(chunk, type, line_start, line_end, body): a chunk begins at each line that begins an article or a chapter. What a chapter line ends is called a chapter, whatever it holds."""
    rows, held, article = [], [], False
    lines = text.splitlines()

    def close(kind: str, end: int) -> None:
        if held:
            rows.append((len(rows), kind, end - len(held) + 1, end, "\n".join(held)))
            held.clear()

    for i, line in enumerate(lines):
        if re.match(r"제\s*\d+\s*조", line.strip()):
            close("article", i - 1)
            article = True
        elif re.match(r"제\s*\d+\s*장", line.strip()):
            close("chapter", i - 1)
        held.append(line)
    close("article" if article else "paragraph", len(lines) - 1)
    return rows


# Sizes of structural chunks in characters.
TARGET_CHARS, MOST_CHARS, LEAST_CHARS = 1200, 1500, 200


def _kind(line: str) -> str:
    if line.startswith("|"):
        return "table"
    if re.match(r"제\s*\d+\s*장", line):
        return "chapter"
    return "article" if re.match(r"제\s*\d+\s*조", line) else "text"


def structural_chunks(text: str) -> list[tuple]:
    """(chunk, is_table, elements, body) of a text's blocks: a table stands alone, a heading closes a chunk that is large enough, any block one that is too large, and a small chunk joins the one before."""
    blocks = [(_kind(b.strip()), b.strip()) for b in re.split(r"\n\s*\n|\n(?=제\s*\d+\s*[조장])", text) if b.strip()]
    made: list[tuple[bool, list[str]]] = []
    held: list[str] = []
    for kind, body in blocks:
        size = sum(map(len, held))
        if held and (kind == "table" or (kind in ("chapter", "article") and size >= TARGET_CHARS)):
            made.append((False, held))
            held = []
        if kind == "table":
            made.append((True, [body]))
            continue
        held.append(body)
        if sum(map(len, held)) >= MOST_CHARS:
            made.append((False, held))
            held = []
    if held:
        made.append((False, held))
    merged: list[list] = []
    for table, parts in made:
        if merged and not table and sum(map(len, parts)) < LEAST_CHARS:
            merged[-1][1] += len(parts)
            merged[-1][2] += "\n\n" + "\n".join(parts)
        else:
            merged.append([table, len(parts), "\n".join(parts)])
    return [(i, *m) for i, m in enumerate(merged)]


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self.skipped = 0
        self.href: str | None = None
        self.said: list[str] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipped += tag in ("script", "style")
        if tag == "a":
            self.href, self.said = dict(attrs).get("href"), []
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.skipped:
            self.skipped -= 1
        elif tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.said).split())))
            self.href = None
        elif tag in ("td", "th") and self.cell is not None:
            if self.rows:
                self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        self.parts.append(data)
        if self.href is not None:
            self.said.append(data)
        if self.cell is not None:
            self.cell.append(data)


def _parsed(html: str) -> _Text:
    p = _Text()
    p.feed(html)
    p.close()
    return p


def html_text(html: str, most: int = 100_000) -> list[tuple]:
    """(text,): what is shown, each run of it a line, cut at a length with a mark."""
    lines = [phrase.strip() for part in _parsed(html).parts for line in part.splitlines() for phrase in line.strip().split("  ")]
    text = "\n".join(x for x in lines if x)
    return [(text if len(text) <= most else text[:most] + "\n... [truncated]",)]


def html_links(html: str) -> list[tuple]:
    """(href, text) of all anchors with a target."""
    return _parsed(html).links


def html_tables(html: str) -> list[tuple]:
    """(row, cells joined by tabs) of table rows with a cell."""
    return [(i, "\t".join(r)) for i, r in enumerate(_parsed(html).rows) if r]


def nfkc(text: str) -> list[tuple]:
    return [(unicodedata.normalize("NFKC", text),)]


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all, by longest matching blocks."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def line_diff(before: str, after: str) -> tuple[int, int, float]:
    """(added lines, removed lines, changed share of the new lines)."""
    old, new = before.splitlines(), after.splitlines()
    added = removed = 0
    for line in difflib.unified_diff(old, new, lineterm="", n=0):
        added += line.startswith("+") and not line.startswith("+++")
        removed += line.startswith("-") and not line.startswith("---")
    return added, removed, (added + removed) / max(1, len(new))


def common_lines(old: Sequence, new: Sequence) -> int:
    """The length of the longest common subsequence of lines, or of characters. Both ends are cut off as far as they agree; the rest takes a bit for each new line and one pass of the old ones."""
    first = 0
    while first < min(len(old), len(new)) and old[first] == new[first]:
        first += 1
    last = 0
    while last < min(len(old), len(new)) - first and old[-1 - last] == new[-1 - last]:
        last += 1
    places: dict[str, int] = {}
    for k, line in enumerate(new[first : len(new) - last]):
        places[line] = places.get(line, 0) | 1 << k
    whole = (1 << len(new) - last - first) - 1
    left = whole
    for line in old[first : len(old) - last]:
        if hit := left & places.get(line, 0):
            left = ((left + hit) | (left - hit)) & whole
    return first + last + (whole ^ left).bit_count()


def line_changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, added, removed, change_ratio) of two versions of each text: the lines of the shortest diff, in order, so a line that moves is removed and added, and their share of the newer lines. Lines end at \\n; empty and null texts have none."""
    lines = lambda t: t.split("\n") if t else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column("left_"), batch.column("right_"), strict=True):
                old, new = lines(a.as_py()), lines(b.as_py())
                kept = common_lines(old, new)
                found.append((len(new) - kept, len(old) - kept, round((len(new) + len(old) - 2 * kept) / max(1, len(new)), 6)))
            made = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *made], names=[key, "added", "removed", "change_ratio"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, F.col(before).alias("left_"), F.col(after).alias("right_")).mapInArrow(run, f"`{key}` {kind}, added long, removed long, change_ratio double")


def compared(pairs: DataFrame, keep: list[str], left: str, right: str) -> DataFrame:
    """The columns ``keep`` of text pairs with ratio, added, removed and change_ratio."""
    fields = [f for f in pairs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ratio double, added int, removed int, change_ratio double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(a or "", b or "") for a, b in zip(batch.column("left_").to_pylist(), batch.column("right_").to_pylist(), strict=True)]
            diffs = [line_diff(a, b) for a, b in both]
            made = [pa.array([round(ratio(a, b), 6) for a, b in both], pa.float64()), pa.array([d[0] for d in diffs], pa.int32()), pa.array([d[1] for d in diffs], pa.int32()), pa.array([round(d[2], 6) for d in diffs], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], *made], names=[*(f.name for f in fields), "ratio", "added", "removed", "change_ratio"])

    return pairs.select(*[F.col(f.name) for f in fields], F.col(left).alias("left_"), F.col(right).alias("right_")).mapInArrow(run, schema)


def ratio_from(matcher: difflib.SequenceMatcher, least: float) -> float | None:
    """The matcher's ratio, or None as soon as it can't be ``least``: what is not matched yet adds the shorter side of each open range at most. The widest range is matched first; their order changes no block."""
    total = len(matcher.a) + len(matcher.b)
    if not total:
        return 1.0
    need, matched = least * total / 2 - 1e-9, 0
    bound = min(len(matcher.a), len(matcher.b))
    ranges = [(-bound, 0, len(matcher.a), 0, len(matcher.b))]
    while ranges and matched + bound >= need:
        width, a, a_end, b, b_end = heapq.heappop(ranges)
        bound += width
        i, j, n = matcher.find_longest_match(a, a_end, b, b_end)
        if n:
            matched += n
            for x in ((a, i, b, j), (i + n, a_end, j + n, b_end)):
                if width := min(x[1] - x[0], x[3] - x[2]):
                    heapq.heappush(ranges, (-width, *x))
                    bound += width
    return None if ranges or matched < need else 2.0 * matched / total


class AnchorMatcher:
    """difflib's matching blocks of many first texts and one second text, found from the characters of the first that difflib looks up: all of a short second text's, and those that make up a hundredth of a long one at most. All other places are passed over."""

    def __init__(self, b: str) -> None:
        self.b = b
        places: dict[str, list[int]] = {}
        for j, char in enumerate(b):
            places.setdefault(char, []).append(j)
        if len(b) >= 200:
            places = {c: at for c, at in places.items() if len(at) <= len(b) // 100 + 1}
        self.places = places
        self.known = re.compile("[" + "".join(map(re.escape, places)) + "]") if places else None

    def set_seq1(self, a: str) -> None:
        self.a = a
        self.marks = [m.start() for m in self.known.finditer(a)] if self.known else []

    def find_longest_match(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        a, b, marks, places = self.a, self.b, self.marks, self.places
        i, j, size = alo, blo, 0
        before: dict[int, int] = {}
        last = -2
        for at in range(bisect.bisect_left(marks, alo), bisect.bisect_left(marks, ahi)):
            x = marks[at]
            if x != last + 1:
                before = {}
            now: dict[int, int] = {}
            held = places[a[x]]
            for k in range(bisect.bisect_left(held, blo), len(held)):
                y = held[k]
                if y >= bhi:
                    break
                n = now[y] = before.get(y - 1, 0) + 1
                if n > size:
                    i, j, size = x - n + 1, y - n + 1, n
            before, last = now, x
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        return i, j, size


def alike(pairs: DataFrame, keep: list[str], left: str, right: str, least: float) -> DataFrame:
    """The columns ``keep`` of text pairs with their ratio, rounded, where it is at least ``least``. Pairs with equal right texts side by side are quicker."""
    fields = [f for f in pairs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ratio double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = difflib.SequenceMatcher(None)
        for batch in batches:
            at, found = [], []
            for k, (a, b) in enumerate(zip(batch.column("left_"), batch.column("right_"), strict=True)):
                one, other = a.as_py() or "", b.as_py() or ""
                if one == other:
                    score = 1.0
                elif 2.0 * min(len(one), len(other)) < (least - 1e-6) * (len(one) + len(other)):
                    continue
                else:
                    if other != matcher.b:  # the matcher keeps what it knows of the second text
                        matcher.set_seq2(other)
                    matcher.set_seq1(one)
                    score = ratio_from(matcher, least - 1e-6)
                if score is not None and round(score, 6) >= least:
                    at.append(k)
                    found.append(round(score, 6))
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[kept.column(f.name) for f in fields], pa.array(found, pa.float64())], names=[*(f.name for f in fields), "ratio"])

    return pairs.select(*[F.col(f.name) for f in fields], F.col(left).alias("left_"), F.col(right).alias("right_")).mapInArrow(run, schema)
