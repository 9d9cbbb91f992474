"""Words of Thai text, which is written without spaces: maximal matching over the lattice of a dictionary's words.

A word may end only where a character cluster ends. Of all ways to cover a run of Thai letters the one with the fewest
letters outside words counts, then the one with the fewest words, then the one whose first word is longest, and so on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

#: Words of a dictionary that every Python worker holds, at most.
DICTIONARY_WORDS = 500_000
#: A run of Thai letters and signs (not digits), or a word in another script.
_PIECES = re.compile("[ก-ฺเ-๎]+|(?:(?![ก-ฺเ-๎])\\w)+")
_THAI = "[ก-ฺเ-๎]"
_THAI_AT = re.compile(_THAI).match
_LEADING = frozenset("เแโใไ")  # vowels written ahead of their consonant
_FOLLOWING = frozenset("ะัาำิีึืฺุูๅ็่้๊๋์ํ๎")  # vowels, tones and signs that hang on what stands ahead


def cluster_ends(run: str) -> list[bool]:
    """For each place from 0 to len(run): whether a cluster may end there. A leading vowel keeps its consonant, a following
    sign stays with it, and the short a inside a syllable (ั) needs a consonant after it."""
    inside = (not (b in _FOLLOWING or a in _LEADING or a == "ั") for a, b in zip(run, run[1:]))
    return [True, *inside, True] if run else [True]


def prefixes(words: list[str]) -> dict[str, bool]:
    """A dictionary's trie as a table: each beginning of a word, and whether it is a word."""
    out: dict[str, bool] = {}
    for w in words:
        for i in range(1, len(w)):
            out.setdefault(w[:i], False)
        if w:
            out[w] = True
    return out


def segment(run: str, trie: dict[str, bool]) -> list[str]:
    """The words of a run; neighbouring letters outside words stay together."""
    ends = cluster_ends(run)

    def words_at(i: int) -> Iterator[int]:
        for j in range(i + 1, len(run) + 1):
            if (hit := trie.get(run[i:j])) is None:
                return
            if hit and ends[j]:
                yield j

    return cover(run, ends, words_at)


def cover(run: str, ends: Sequence[bool], words_at: Callable[[int], Iterable[int]]) -> list[str]:
    """segment(), for where clusters may end and, for each place, where the words that begin there end, shortest first."""
    out: list[str] = []
    open_ = False
    for i, j, known in steps(len(run), ends, words_at):
        if known or not open_:
            out.append(run[i:j])
        else:
            out[-1] += run[i:j]
        open_ = not known
    return out


def steps(n: int, ends: Sequence[bool], words_at: Callable[[int], Iterable[int]]) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, whether a word) of the words and of the single clusters outside words that cover n letters best."""
    dear = n + 1  # a letter outside costs more than all words
    best, step, known = [0] * (n + 1), [n] * (n + 1), [False] * (n + 1)
    after = n
    for i in range(n - 1, -1, -1):
        if not ends[i]:
            continue
        cost, to, word = best[after] + dear * (after - i), after, False
        for j in words_at(i):
            if best[j] + 1 <= cost:
                cost, to, word = best[j] + 1, j, True
        best[i], step[i], known[i] = cost, to, word
        after = i
    i = 0
    while i < n:
        yield i, step[i], known[i]
        i = step[i]


#: Characters that are looked up at once, and what a character's number is multiplied with to make room for the next.
LOOKED_UP, _CODES = 500_000, np.uint64(1 << 21)


def packed(words: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A dictionary's trie as sorted numbers, exact: for each length, (place of the beginning one letter shorter, last
    letter) of each beginning of a word, and whether it is a word. Nine bytes for each beginning."""
    parts = [np.frombuffer("".join(c.to_pylist()).encode("utf-32-le"), "<u4") for c in words.chunks]
    codes = np.concatenate([np.empty(0, "<u4"), *parts])
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    node = np.zeros(len(size), np.uint64)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    while (on := size > len(levels)).any():
        size, start, node = size[on], start[on], node[on]
        keys, at = np.unique(node * _CODES + codes[start + len(levels)], return_inverse=True)
        whole = np.zeros(len(keys), bool)
        whole[at[size == len(levels) + 1]] = True
        levels.append((keys, whole))
        node = at.astype(np.uint64)
    return levels


def _marked(signs: Iterable[str]) -> np.ndarray:
    """For each character from the first Thai letter to the last sign (and one more for all others): whether it is a sign."""
    out = np.zeros(_SPAN + 1, bool)
    out[[ord(c) - _FIRST for c in signs]] = True
    return out


_FIRST, _SPAN = ord("ก"), ord("๎") - ord("ก") + 1
_AFTER, _BEFORE = _marked(_FOLLOWING), _marked(_LEADING | {"ั"})  # no cluster ends ahead of the one, nor behind the other


def cut_runs(codes: np.ndarray, size: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """segment() of runs by a packed dictionary: where their words begin. codes: the characters of all runs, one after the
    other; size: how many each has.

    All places are looked up letter by letter at once. Where no word of the dictionary reaches over the end of a cluster,
    every way to cover the run stops, so what lies between two such places is covered on its own; most often it is one word
    or one cluster, and only what is neither is tried out (steps).
    """
    n = len(codes)
    start = np.cumsum(size) - size
    sign = np.minimum(codes - np.uint32(_FIRST), np.uint32(_SPAN))  # what lies below wraps around
    may = np.ones(n + 1, bool)
    may[1:n] = ~(_AFTER[sign[1:]] | _BEFORE[sign[:-1]])
    may[start] = True
    place = np.flatnonzero(may[:n])
    last = np.repeat(start + size, size)[place]
    node = np.zeros(len(place), np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth, (keys, whole) in enumerate(levels):
        on = place + depth < last
        place, node, last = place[on], node[on], last[on]
        if not len(place):
            break
        wanted = node * _CODES + codes[place + depth]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        on = keys[at] == wanted
        place, at, last = place[on], at[on], last[on]
        word = whole[at] & may[place + depth + 1]
        found.append((place[word], place[word] + depth + 1))
        node = at.astype(np.uint64)
    begin, end = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    over = np.cumsum(np.bincount(begin + 1, minlength=n + 2)[: n + 1] - np.bincount(end, minlength=n + 2)[: n + 1]) > 0
    stops = np.flatnonzero(may & ~over)  # n is one of them
    a, z = stops[:-1], stops[1:]
    into = np.searchsorted(a, begin, "right") - 1
    word, tried = np.zeros(len(a), bool), np.zeros(len(a), bool)
    tried[into] = True
    word[into[(begin == a[into]) & (end == z[into])]] = True
    tried &= ~word
    more, known = [], []
    own = np.flatnonzero(tried[into]) if tried.any() else np.empty(0, np.int64)
    own = own[np.argsort(into[own], kind="stable")]  # shorter words were found first
    first = np.searchsorted(into[own], np.flatnonzero(tried), "left").tolist()
    for k, lo, hi in zip(np.flatnonzero(tried).tolist(), first, [*first[1:], len(own)]):
        words: dict[int, list[int]] = {}
        for b, e in zip((begin[own[lo:hi]] - a[k]).tolist(), (end[own[lo:hi]] - a[k]).tolist()):
            words.setdefault(b, []).append(e)
        for i, _, is_word in steps(int(z[k] - a[k]), may[a[k] : z[k] + 1].tolist(), lambda i, words=words: words.get(i, ())):
            more.append(int(a[k]) + i)
            known.append(is_word)
    at = np.concatenate([a[~tried], np.array(more, np.int64)])
    is_word = np.concatenate([word[~tried], np.array(known, bool)])
    order = np.argsort(at, kind="stable")
    at, is_word = at[order], is_word[order]
    opens = is_word.copy()  # neighbouring clusters outside words stay together
    opens[1:] |= is_word[:-1]
    opens |= np.isin(at, start[size > 0])
    return at[opens]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def segment_all(runs: list[str], levels: list[tuple[np.ndarray, np.ndarray]]) -> list[list[str]]:
    """segment() of each run by a packed dictionary."""
    size = np.array([len(r) for r in runs], np.int64)
    whole, at = "".join(runs), cut_runs(_codes(runs), size, levels)
    words = [whole[a:z] for a, z in zip(at.tolist(), [*at[1:].tolist(), len(whole)])]
    bounds = np.searchsorted(at, np.cumsum([0, *size])).tolist()
    return [words[a:z] for a, z in zip(bounds, bounds[1:])]


def split_all(texts: list[str | None], levels: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """split_words() of each text by a packed dictionary; words are never Python strings, those without Thai letters aside."""
    pieces = [_PIECES.findall(t or "") for t in texts]
    flat = [p for found in pieces for p in found]
    thai = np.array([bool(_THAI_AT(p)) for p in flat], bool)
    runs, others = [p for p, is_thai in zip(flat, thai.tolist()) if is_thai], [p.lower() for p, is_thai in zip(flat, thai.tolist()) if not is_thai]
    size = np.array([len(r) for r in runs], np.int64)
    at = cut_runs(_codes(runs), size, levels)
    ends = np.append(at, size.sum()).astype(np.int64)
    # Thai letters have three bytes each
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer((ends * 3).astype("i4")), pa.py_buffer("".join(runs).encode()))
    chars = np.diff(ends)
    each = np.ones(len(flat), np.int64)
    each[thai] = np.diff(np.searchsorted(at, np.cumsum([0, *size])))
    if others:
        cut = np.repeat(thai, each)
        order = np.empty(len(cut), np.int64)
        order[cut], order[~cut] = np.arange(len(at)), len(at) + np.arange(len(others))
        words = pa.concat_arrays([words, pa.array(others, pa.string())]).take(pa.array(order))
        chars = np.concatenate([chars, [len(p) for p in others]])[order]
    owner = np.repeat(np.repeat(np.arange(len(texts)), [len(found) for found in pieces]), each)
    kept = chars > 1
    offsets = np.cumsum([0, *np.bincount(owner[kept], minlength=len(texts))])
    none = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), words.filter(pa.array(kept)), mask=none)


def split_words(text: str, trie: dict[str, bool]) -> list[str]:
    """Lower-cased words of two characters or more."""
    out: list[str] = []
    for piece in _PIECES.findall(text):
        out += segment(piece, trie) if re.match(_THAI, piece) else [piece.lower()]
    return [w for w in out if len(w) > 1]


_TRIES: dict[str, dict[str, bool]] = {}


def segmenter(dictionary: DataFrame, column: str = "word") -> Callable[[Column], Column]:
    """A function like tokens() that also parts Thai words; texts without Thai letters never leave the JVM.

    dictionary: a table of words, of which every worker holds a copy: at most DICTIONARY_WORDS, checked. Null and repeated
    words don't count, nor does their order. An empty dictionary leaves each run whole.
    """
    kept = dictionary.select(column).where(F.col(column).isNotNull()).distinct()
    words = sorted(r[0] for r in kept.limit(DICTIONARY_WORDS + 1).collect())
    if len(words) > DICTIONARY_WORDS:
        raise ValueError(f"a dictionary of more than {DICTIONARY_WORDS} words")
    held = dictionary.sparkSession.sparkContext.broadcast(words)
    name = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def thai(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _TRIES:  # one trie a worker
            _TRIES.clear()
            _TRIES[name] = prefixes(held.value)
        for texts in parts:
            yield texts.map(lambda t: None if t is None else split_words(t, _TRIES[name]))

    return lambda c: F.coalesce(thai(F.when(F.regexp_like(c, F.lit(_THAI)), c)), tokens(c))


_PACKED: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


def large_segmenter(dictionary: DataFrame, column: str = "word") -> Callable[[Column], Column]:
    """segmenter() for a dictionary of any size, with the same words: a worker holds nine bytes for each beginning of a word
    (1.8 million words have about 5 million), not a table of strings."""
    kept = dictionary.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    held = dictionary.sparkSession.sparkContext.broadcast(packed(kept.toArrow().column(0)))
    name = uuid.uuid4().hex

    @F.arrow_udf("array<string>")
    def thai(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _PACKED:
            _PACKED.clear()
            _PACKED[name] = held.value
        for texts in parts:
            done: list[pa.Array] = []
            size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
            upto = np.cumsum(size)
            a = 0
            while a < len(texts):
                z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LOOKED_UP, "right")))
                done.append(split_all(texts.slice(a, z - a).to_pylist(), _PACKED[name]))
                a = z
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    return lambda c: F.coalesce(thai(F.when(F.regexp_like(c, F.lit(_THAI)), c)), tokens(c))
