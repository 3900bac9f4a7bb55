"""Word hashes of whole Arrow string columns, computed with numpy.

A word's hash mixes two Karp-Rabin polynomials over its bytes, modulo 2**64 and modulo
the prime 2**31 - 1, each brought to position zero with its multiplier's inverse. Words that
agree modulo 2**64 whatever the multiplier, as the Thue-Morse word and its complement
do, differ modulo the prime. All words of a block come from running sums, so there is
no Python loop over words or texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 2 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
PRIME = (1 << 31) - 1
PRIME_MULTIPLIER = 0x3C6EF372
PRIME_INVERSE = pow(PRIME_MULTIPLIER, -1, PRIME)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: True for the bytes between words: space and \t\n\v\f\r.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: True for every ASCII byte that is neither a letter nor a digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1), base, dtype=U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= BLOCK + 1:
            _powers[base] = have
    return have[:n]


def _prime_power(base: int, n: int) -> np.ndarray:
    """Powers modulo the prime, by doubling."""
    have = _powers.get(-base)
    if have is None or len(have) < n:
        have = np.ones(max(n, BLOCK + 1), dtype=U)
        done = 1
        while done < len(have):
            more = min(done, len(have) - done)
            have[done : done + more] = have[:more] * U(pow(base, done, PRIME)) % U(PRIME)
            done += more
        if n <= BLOCK + 1:
            _powers[-base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _pieces(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about BLOCK bytes at text ends or, in longer texts, between words."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = int(offsets[np.searchsorted(offsets, at + BLOCK, "right") - 1])
        if to <= at:
            stop = int(offsets[np.searchsorted(offsets, at, "right")])
            cuts = np.flatnonzero(between[data[at : min(at + BLOCK, stop)]])
            if len(cuts):
                to = at + int(cuts[-1]) + 1
            else:
                cuts = np.flatnonzero(between[data[at + BLOCK : stop]])
                to = at + BLOCK + int(cuts[0]) + 1 if len(cuts) else stop
        yield at, min(to, end)
        at = to


def _words(texts: pa.Array | pa.ChunkedArray, between: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """The texts' offsets, and for each block its place, its bytes, their running sums, and where its words start and stop."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)

    def pieces() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for lo, hi in _pieces(data, offsets, between) if len(texts) else ():
            piece = _LOWER[data[lo:hi]]
            inside = ~between[piece]
            edges = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
            first = np.zeros(len(piece) + 1, dtype=bool)
            first[edges] = True
            first[0] = first[-1] = True
            start, stop = inside.copy(), inside.copy()
            start[1:] &= ~inside[:-1] | first[1:-1]
            stop[:-1] &= ~inside[1:] | first[1:-1]
            sums = np.zeros(len(piece) + 1, dtype=U)
            np.cumsum((piece.astype(U) + U(1)) * _power(MULTIPLIER, len(piece)), out=sums[1:])
            yield lo, piece, sums, np.flatnonzero(start), np.flatnonzero(stop) + 1

    return offsets, pieces()


def _prime_hashes(piece: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The words' polynomials modulo the prime. A term is folded once, to 32 bits, so a running sum of 2**31 bytes fits."""
    terms = (piece.astype(U) + U(1)) * _prime_power(PRIME_MULTIPLIER, len(piece))
    sums = np.zeros(len(piece) + 1, dtype=U)
    np.cumsum((terms & U(PRIME)) + (terms >> U(31)), out=sums[1:])
    return (sums[stops] - sums[starts]) % U(PRIME) * _prime_power(PRIME_INVERSE, len(piece))[starts] % U(PRIME)


def word_hashes(texts: pa.Array | pa.ChunkedArray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's words begin (one entry more than texts).

    Null texts have no words.
    """
    offsets, pieces = _words(texts, between)
    hashes, begins = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for lo, piece, sums, starts, stops in pieces:
        own = mix((sums[stops] - sums[starts]) * _power(INVERSE, len(sums) - 1)[starts] + (stops - starts).astype(U))
        hashes.append(mix(own ^ (_prime_hashes(piece, starts, stops) * U(MULTIPLIER))))
        begins.append(starts + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def prefix_hashes(texts: pa.Array | pa.ChunkedArray, sizes: tuple[int, ...], between: np.ndarray = PUNCTUATION) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size the hashes of all words' first bytes, and where each text's words begin.

    A word shorter than the size is hashed with its end, so ``scum`` is not ``scumble``.
    """
    offsets, pieces = _words(texts, between)
    hashes: list[list[np.ndarray]] = [[np.zeros(0, U)] for _ in sizes]
    begins = [np.zeros(0, np.int64)]
    for lo, _, sums, starts, stops in pieces:
        back = _power(INVERSE, len(sums) - 1)[starts]
        for out, size in zip(hashes, sizes, strict=True):
            ends = np.minimum(starts + size, stops)
            out.append(mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(U) + np.where(stops - starts < size, U(1 << 32), U(0))))
        begins.append(starts + lo)
    return [np.concatenate(h) for h in hashes], np.searchsorted(np.concatenate(begins), offsets)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence if it is shorter; none of nothing."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=U)
    for i in range(k):
        out = mix(out * U(MULTIPLIER) + words[i : i + n])
    return out


def running_hash(words: np.ndarray) -> np.ndarray:
    """The Karp-Rabin sums of a sequence of words up to each place, one more than words."""
    sums = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * _power(MULTIPLIER, len(words)), out=sums[1:])
    return sums


def rolling(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that begin at some places: two sums and one multiplication for each."""
    return mix((sums[at + n] - sums[at]) * _power(INVERSE, len(sums))[at] + U(n))


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes."""
    words, at = word_hashes(texts)
    return [np.unique(windows(words[at[i] : at[i + 1]], k)) for i in range(len(at) - 1)]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's texts take about ``limit`` bytes in each; a longer text stays alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
