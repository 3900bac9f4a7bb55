"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import calendar
import datetime
import hashlib
import hmac
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset([tuple(words)])


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) by all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def tiled(item: list[str], doc: list[str], match: int) -> int:
    """Words of the item covered by greedy string tiling, by comparing all places."""
    used_i, used_d, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best: tuple[int, int, int] | None = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not used_i[i + n] and not used_d[d + n]:
                    n += 1
                if n >= match and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return covered
        n, i, d = best
        used_i[i : i + n] = [True] * n
        used_d[d : d + n] = [True] * n
        covered += n


def items_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text or "")) if w]


def contaminated(docs: list[tuple], items: list[tuple], match: int, coverage: float) -> set[tuple[int, int, int, int]]:
    out = set()
    for d, text in docs:
        for i, item in items:
            words = items_words(item)
            if 0 < len(words) < match:
                covered = len(words) if any(items_words(part) == words for part in re.split(r"[\n.!?]+", text or "")) else 0
            else:
                covered = tiled(words, items_words(text), match) if words else 0
            if covered and covered >= coverage * len(words):
                out.add((d, i, len(words), covered))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end)."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def base_digest(text: str | None) -> str:
    kinds = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base_spans(text)).encode()).hexdigest()


def entropy(text: str, window: int) -> float | None:
    if len(text) < window:
        return None
    return max(-sum(c / window * math.log2(c / window) for c in Counter(text[i : i + window]).values()) for i in range(len(text) - window + 1))


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(text: str) -> Counter:
    codes = [c if c.isalpha() else "\1" for c in text.lower()]
    codes = ["\1", *codes, "\1"]
    out = [c for k, c in enumerate(codes) if k == 0 or c != "\1" or codes[k - 1] != "\1"]
    found: Counter = Counter()
    for k, c in enumerate(out):
        if c != "\1":
            found[(ord(c), 0, 0)] += 1
        if k + 1 < len(out):
            found[(0, ord(c), ord(out[k + 1]))] += 1
        if k + 2 < len(out) and out[k + 1] != "\1":
            found[(ord(c), ord(out[k + 1]), ord(out[k + 2]))] += 1
    return found if any(c != "\1" for c in out) else Counter()


def ranked(counts: Counter, size: int) -> list:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def language(text: str | None, known: dict[str, list], size: int) -> str:
    top = ranked(grams(text or ""), size)
    if not top or not known:
        return "und"
    places = {lang: {g: i for i, g in enumerate(p)} for lang, p in known.items()}
    away = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(top)) for lang, p in places.items()}
    return min(sorted(away), key=lambda x: away[x])


def language_profiles(rows: list[tuple], size: int) -> dict[str, list]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        if lang is not None and text is not None:
            counts[lang].update(grams(text))
    return {lang: ranked(c, size) for lang, c in counts.items() if c}


def shared_budget(budget: int, children: dict, capacity: dict, weight: dict) -> dict:
    """The share of each child, full ones first, in the operator's order."""
    order = sorted((c for c in children if weight[c] > 0), key=lambda c: (capacity[c] * 1000 // weight[c], c))
    out, left = {}, list(order)
    while left:
        c = left[0]
        if capacity[c] * sum(weight[x] for x in left) > (budget - sum(out.values())) * weight[c]:
            break
        out[c] = capacity[c]
        left.pop(0)
    rest, total, run = budget - sum(out.values()), sum(weight[x] for x in left), 0
    for c in left:
        out[c] = min(capacity[c], rest * (run + weight[c]) // total - rest * run // total)
        run += weight[c]
    return out


def mixture(rows: list[tuple], weights: list[dict], percent: int, epochs: int, seed: int) -> dict[int, int]:
    """doc_id -> epochs, of rows (doc_id, tokens, path)."""
    tokens: Counter = Counter()
    for _, n, path in rows:
        tokens[path] += n

    def down(prefix: tuple, budget: int, level: int) -> dict:
        if level == len(weights):
            return {prefix: budget}
        names = sorted({p[level] for p in tokens if p[:level] == prefix})
        capacity = {c: epochs * sum(n for p, n in tokens.items() if p[: level + 1] == (*prefix, c)) for c in names}
        shares = shared_budget(budget, names, capacity, {c: weights[level].get(c, 1) for c in names})
        out = {}
        for c, b in shares.items():
            out |= down((*prefix, c), b, level + 1)
        return out

    taken: dict[int, int] = {}
    for path, budget in down((), sum(tokens.values()) * percent // 100, 0).items():
        own = [(d, n) for d, n, p in rows if p == path]
        whole = budget // tokens[path] if tokens[path] else 0
        left = budget - whole * tokens[path]
        place = lambda d, whole=whole: int(hashlib.md5(f"{seed}:{whole}:{'' if d is None else d}".encode()).hexdigest()[:10], 16)
        run, over = 0, left <= 0
        for d, n in sorted(own, key=lambda x: (place(x[0]), x[0])):
            run += n
            over = over or run > left
            if whole + (not over):
                taken[d] = whole + (not over)
    return taken


def secret_spans(text: str | None, rules) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """All spans (start, kind, end): base spans, and each part of a candidate that they leave and that looks random. ``rules`` is the module with the fixed values."""
    text = text or ""
    base = base_spans(text)
    free = [True] * len(text)
    for start, _, end in base:
        free[start:end] = [False] * (end - start)
    masked = "".join(c if f else " " for c, f in zip(text, free, strict=True))
    out = list(base)
    for m in re.finditer(rules.CANDIDATE, masked):
        part = m[0]
        if not re.search("[0-9]", part) or not re.search("[A-Za-z]", part) or any(re.search(a, part) for a in rules.ALLOW):
            continue
        limit = rules.HEX_BITS if re.fullmatch("[0-9A-Fa-f]+", part) else rules.OTHER_BITS
        windows = [part[i : i + rules.WINDOW] for i in range(len(part) - rules.WINDOW + 1)]
        bits = [entropy(w, rules.WINDOW) for w in windows if not re.search(rules.ALLOW_WINDOW, w)]
        if bits and max(bits) >= limit:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """The text with spans replaced, overlapping ones as one."""
    if text is None or not spans:
        return text
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:]


def hmac_hex(key: str, text: str) -> str:
    return hmac.new(key.encode(), text.encode(), "sha256").hexdigest()


def luhn(digits: str) -> int:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))


def _permuted(text: str, key: str, kind: str) -> str:
    cut = len(text) // 2
    halves = [text[:cut], text[cut:]]
    for i in range(1, 9):
        mine = 1 - i % 2
        digest = hmac_hex(key, f"{kind}|{i}|{halves[1 - mine]}")
        out = []
        for j, c in enumerate(halves[mine]):
            by = int(digest[j % 15 * 4 : j % 15 * 4 + 4], 16)
            low = next(((x, n) for x, n in (("0", 10), ("a", 26), ("A", 26)) if x <= c < chr(ord(x) + n)), None)
            out.append(c if low is None else chr((ord(c) - ord(low[0]) + by) % low[1] + ord(low[0])))
        halves[mine] = "".join(out)
    return "".join(halves)


def _pair(left: int, right: int, a: int, b: int, key: str, kind: str) -> tuple[int, int]:
    for i in range(1, 9):
        if i % 2:
            left = (left + int(hmac_hex(key, f"{kind}|{i}|{right}")[:15], 16) % a) % a
        else:
            right = (right + int(hmac_hex(key, f"{kind}|{i}|{left}")[:15], 16) % b) % b
    return left, right


def _laid(chars: str, like: str, kept: str) -> str:
    rest = iter(chars)
    return "".join(next(rest) if re.fullmatch(f"[{kept}]", c) else c for c in like)


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _day(d: datetime.date, key: str) -> datetime.date:
    first = d.year // 100 * 100
    if d.day <= 12:
        m, r = _pair((d.year - first) * 12 + d.month - 1, d.day - 1, 1200, 12, key, f"early{first}")
        return datetime.date(first + m // 12, m % 12 + 1, r + 1)
    late = [datetime.date(y, m, x) for y in range(first, first + 100) for m in range(1, 13) for x in range(13, calendar.monthrange(y, m)[1] + 1)]
    a, b = (4, 5531) if first == 1900 else (125, 177)
    n = late.index(d)
    p, q = _pair(n // b, n % b, a, b, key, f"late{first}")
    return late[p * b + q]


def _date(y: int, m: int, d: int) -> datetime.date | None:
    try:
        return datetime.date(y, m, d) if 1900 <= y < 2100 else None
    except ValueError:
        return None


def _pseudonym(kind: str, m: str, key: str, rules) -> str | None:  # noqa: ANN001, PLR0911
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        at = m.index("@")
        return _permuted(m[:at], key, kind) + m[at:]
    if kind == "iban":
        compact = m.replace(" ", "")
        if not 15 <= len(compact) <= 34 or _iban_rest(compact) != 1:
            return None
        body = _permuted(compact[4:], key, kind)
        return _laid(f"{compact[:2]}{98 - _iban_rest(compact[:2] + '00' + body):02d}{body}", m, "A-Z0-9")
    if kind == "ip":
        p = [int(x) for x in m.split(".")]
        if max(p) > 255:
            return None
        left, right = _pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, kind)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "date":
        parts = [int(x) for x in re.split("[-/.]", m)]
        sep = re.search("[-/.]", m)[0]
        if len(re.split("[-/.]", m)[0]) == 4:
            d, order = _date(*parts), "ymd"
        elif sep == "/" and parts[1] > 12:
            d, order = _date(parts[2], parts[0], parts[1]), "mdy"
        else:
            d, order = _date(parts[2], parts[1], parts[0]), "dmy"
        if d is None:
            return None
        new = _day(d, key)
        return sep.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[x] for x in order)
    if kind == "ssn":
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        left, right = _pair(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, kind)
        return f"{left + (2 if left >= 665 else 1):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if kind == "phone":
        plain = m.replace("(0)", "(_)")
        own = re.sub("[^0-9]", "", plain)
        if not 8 <= len(digits) <= 15:
            return None
        code = next((c for c in rules.CALLING if own.startswith(c)), own[:3])
        return _laid(code + _permuted(own[len(code) :], key, kind), plain, "0-9").replace("(_)", "(0)")
    if luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = digits[0] + _permuted(digits[1:-1], key, kind)
    return _laid(body + str(-luhn(body + "0") % 10), m, "0-9")


def pseudonymised(text: str | None, key: str, rules) -> tuple[str | None, list[str]]:  # noqa: ANN001
    """The text with pseudonyms, and their kinds in order. ``rules`` is the module with the patterns."""
    kinds: list[str] = []

    def new(m: re.Match) -> str:
        for kind in rules.KINDS:
            if re.fullmatch(rules.PATTERNS[kind], m[0]) and (found := _pseudonym(kind, m[0], key, rules)) is not None:
                kinds.append(kind)
                return found
        return m[0]

    return (text, []) if text is None else (re.sub(rules.ANY, new, text), kinds)


def quality_votes(text: str | None) -> list[int]:
    """The outcomes of the eight quality rules in their order: 2 good, 1 bad, 0 neither."""
    text = text or ""
    n, chars, symbols, again, repeated = measures(text)
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    letters, distinct = sum(c.isalpha() for c in text), len(set(words))
    ended = sum(bool(re.search(r"[.!?:;\"')\]\u2026\u201d][\x20\x09-\x0D]*$", x)) for x in lines)
    vote = lambda bad, good: 1 if bad else 2 if good else 0
    if not n:
        return [1] + [0] * 7
    return [
        vote(n < 50 or n > 100_000, n >= 100), vote(chars / n < 3 or chars / n > 12, 3.5 <= chars / n <= 9), vote(symbols / n > 0.1, symbols / n < 0.02 and n >= 20), vote(len(lines) >= 3 and again / len(lines) > 0.3, again == 0 and len(lines) >= 3),
        vote(repeated / n > 0.2, repeated / n < 0.05 and n >= 50), vote(letters / chars < 0.8, letters / chars > 0.9 and n >= 20), vote(len(lines) >= 3 and ended / len(lines) < 0.2, ended / len(lines) > 0.7 and n >= 20), vote(distinct / n < 0.15 and 50 <= n < 2000, distinct / n > 0.3 and n >= 50),
    ]


def quality_posteriors(votes: list[list[int]], steps: int) -> list[float]:
    """EM over all rows one by one, with one vote of each kind beforehand."""
    good = [1 / (1 + math.exp(-sum((v == 2) - (v == 1) for v in row))) for row in votes]
    before = -1.0
    for _ in range(steps):
        share = sum(good)
        prior = math.log((share + 1) / (len(votes) - share + 1))
        adds = []
        for r in range(len(votes[0])):
            rate = {}
            for side in (0, 1):
                n = {v: 1 + sum(g if side else 1 - g for row, g in zip(votes, good, strict=True) if row[r] == v) for v in (1, 2)}
                rate[side] = {v: n[v] / (n[1] + n[2]) for v in n}
            adds.append({0: 0.0, 1: min(0.0, math.log(rate[1][1] / rate[0][1])), 2: max(0.0, math.log(rate[1][2] / rate[0][2]))})
        good = [1 / (1 + math.exp(-(prior + sum(adds[r][v] for r, v in enumerate(row))))) for row in votes]
        if abs(share - before) < 1e-9 * len(votes):
            break
        before = share
    return good


def filled(doc_id: int | None, text: str | None, units: re.Pattern) -> tuple:
    """(n, form, prefix, middle, output) of a text cut by units."""
    text = text or ""
    pieces = units.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    x, y = sorted((h[0] % (len(pieces) + 1), h[1] % (len(pieces) + 1)))
    prefix, middle, suffix = "".join(pieces[:x]), "".join(pieces[x:y]), "".join(pieces[y:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(text), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(text), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def planted(doc_id: int | None, text: str | None) -> list[str]:
    """The words of a text with the run of the query's contract."""
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if words and h is not None and h % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def periodic(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, from the definition."""
    n, found = len(words), set()
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, stop = i, j + p
            least = next(q for q in range(1, p + 1) if all(words[k] == words[k + q] for k in range(start, stop - q)))
            if j > i and least == p and stop - start >= max(6, 4 * p):
                found.add((start, stop - start, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def run_row(words: list[str]) -> tuple:
    """n_runs, the best run, its exponent and the two digests."""
    runs = periodic(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *top, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(kept)))


def without_lines(docs: list[tuple[int | None, str | None]], least_chars: int, least_docs: int) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, text) of each document."""
    holders: dict[str, set[int]] = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        split = (text or "").split("\n")
        kept = [line for line in split if not (i is not None and len(holders.get(key(line), ())) >= least_docs and i != max(holders[key(line)]))]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return out


def posteriors(votes: list[list[int]], start: list[float], least: float, steps: int) -> list[float]:
    """Posteriors of toxic by expectation-maximisation, row by row and pair by pair of voters."""
    n, width, post = len(votes), len(votes[0]), list(start)
    share = min(max(sum(post) / n, 1e-4), 1 - 1e-4)

    def correlation(a: int, b: int) -> float:
        total = 0.0
        for side in (0, 1):
            w = [p if side else 1 - p for p in post]
            size = sum(w) + 2
            mean = [sum(x * (r[k] != 0) for x, r in zip(w, votes, strict=True)) / size for k in (a, b)]
            spread = [math.sqrt(max(m * (1 - m), 1e-9)) for m in mean]
            total += sum(w) / n * sum(x * ((r[a] != 0) - mean[0]) * ((r[b] != 0) - mean[1]) for x, r in zip(w, votes, strict=True)) / size / (spread[0] * spread[1])
        return total

    for _ in range(steps):
        weight = []
        for k in range(width):
            right = sum(p if r[k] > 0 else 1 - p for p, r in zip(post, votes, strict=True) if r[k])
            sure = min(max((right + 1) / (sum(r[k] != 0 for r in votes) + 2), 0.5), 0.999)
            others = [correlation(k, b) for b in range(width) if b != k]
            weight.append(math.log(sure / (1 - sure)) / (1 + sum(min(c, 1) for c in others if c >= least)))
        now = []
        for r in votes:
            odds = math.log(share / (1 - share)) + sum(v * w for v, w in zip(r, weight, strict=True))
            now.append(1 / (1 + math.exp(-min(max(odds, -50), 50))))
        moved, post = max(abs(a - b) for a, b in zip(now, post, strict=True)), now
        if moved < 1e-6:
            break
    return post


def _mix(x: int) -> int:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by % 2**64
    return x ^ x >> 31


def beginnings(text: str | None, sizes: tuple[int, ...], base: int) -> set[int]:
    """Hashes of the first bytes of all words, by sizes; a shorter word with its end."""
    out = set()
    for word in items_words(text):
        raw = word.encode()
        for size in sizes:
            head = raw[:size]
            out.add(_mix((sum((b + 1) * pow(base, i, 2**64) for i, b in enumerate(head)) + len(head) + (2**32 if len(raw) < size else 0)) % 2**64))
    return out
