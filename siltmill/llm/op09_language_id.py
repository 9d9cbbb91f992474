"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a text's vector bundles (adds) its n-grams' vectors; a language's prototype bundles the
unit vectors of its training texts. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Ids of letters that this worker has met, by code point; 0 is no letter.
_IDS: list[np.ndarray] = []
_LETTERS: list[int] = [0]
#: Texts whose vectors are held at once.
TEXTS = 512
#: N-gram codes are counted in a table up to this many bits, else by sorting.
TABLE_BITS = 21


def letter_ids(points: np.ndarray) -> np.ndarray:
    """Small ids of the code points' letters, 0 for anything else; new letters get the next ids."""
    if not _IDS:
        _IDS.append(np.full(0x110000, -1, np.int32))
    ids = _IDS[0]
    for p in np.unique(points[ids[points] < 0]).tolist():
        if chr(p).isalpha():
            ids[p] = len(_LETTERS)
            _LETTERS.append(p)
        else:
            ids[p] = 0
    return ids[points]


@dataclass(frozen=True)
class Space:
    """The random vectors, dims long: each letter of any script, and the gap between words, has its own."""

    dims: int = 1024
    seed: int = 20240917

    def vector(self, letter: int) -> np.ndarray:
        """+1 and -1 of the letter's code point (0: the gap)."""
        return np.random.default_rng((self.seed, letter)).choice(np.array([-1, 1], np.int8), self.dims)

    def letters(self) -> list[np.ndarray]:
        """The letters' vectors of this worker, by their place in a trigram; they grow as letters are met."""
        return [np.zeros((0, self.dims), np.int8) for _ in range(3)]

    def _known(self, held: list[np.ndarray]) -> None:
        new = [self.vector(p) for p in _LETTERS[len(held[0]) :]]
        if new:
            for place, shift in enumerate((2, 1, 0)):
                held[place] = np.concatenate([held[place], np.roll(np.stack(new), shift, axis=1)])

    def bundle(self, texts: list[str], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(a vector for each text, whether it has a letter). Sums are whole numbers, so their order does not matter."""
        out, has = np.zeros((len(texts), self.dims), np.float32), np.zeros(len(texts), bool)
        for start in range(0, len(texts), 64):
            letters: list[np.ndarray] = []
            for i, t in enumerate(texts[start : start + 64], start):
                c = letter_ids(np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4"))
                has[i] = c.any()
                c = np.concatenate([[0], c, [0]])
                letters.append(c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int32))
            self._known(held)
            bits = max(1, (len(_LETTERS) - 1).bit_length())
            mask = (1 << bits) - 1
            wide = np.int32 if 3 * bits < 31 else np.int64
            part = [(c[:-2].astype(wide) << 2 * bits) | (c[1:-1].astype(wide) << bits) | c[2:] for c in letters]
            flat = np.concatenate(part)
            if not len(flat):
                continue
            if 3 * bits <= TABLE_BITS:
                kinds = np.flatnonzero(np.bincount(flat, minlength=1))
                place = np.zeros(kinds[-1] + 1, np.int32)
                place[kinds] = np.arange(len(kinds))
                which = place[flat]
            else:
                kinds, which = np.unique(flat, return_inverse=True)
            rows = np.repeat(np.arange(len(part)), [len(g) for g in part])
            counts = np.bincount(rows * len(kinds) + which, minlength=len(part) * len(kinds)).reshape(len(part), -1).astype(np.float32)
            a, b, c = held
            bound = a[kinds >> 2 * bits] * b[(kinds >> bits) & mask] * c[kinds & mask]
            out[start : start + 64] = counts @ bound.astype(np.float32)
        return out, has


@dataclass(frozen=True)
class Profiles:
    space: Space
    langs: tuple[str, ...]
    prototypes: np.ndarray  # a unit row for each language


def train(docs: DataFrame, rows_per_lang: int = 3000, space: Space = Space()) -> Profiles:
    """Prototypes from rows (text, lang); null texts, null langs and texts without a letter teach nothing.

    Of a language with more different texts, about rows_per_lang are taken by a hash of the text (the documented bound),
    each once, so a text that very many rows repeat counts as one. Languages are label values, so their number is small;
    one vector for each comes to the driver. Without any labelled row every prediction is `und`.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text").alias("_key"))
    sizes = rows.select("lang", "_key").distinct().groupBy("lang").count().collect()
    if not sizes:
        return Profiles(space, (), np.zeros((0, space.dims)))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_lang / r["count"])))])
    chosen = rows.where(F.pmod("_key", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    chosen = chosen.groupBy("lang", "_key").agg(F.first("text").alias("text")).select("text", "lang")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = space.letters(), {}
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                pdf = whole.slice(at, TEXTS).to_pandas()
                v, has = space.bundle(pdf["text"].tolist(), held)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                unit = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype("f8")
                for lang in pdf["lang"].unique():
                    total[lang] = total.get(lang, 0) + unit[(pdf["lang"] == lang).to_numpy() & has].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    sums = chosen.mapInArrow(learn, "lang string, v array<double>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.round(F.sum("col"), 6).alias("v"))
    made: dict[str, np.ndarray] = {}
    for r in sums.collect():  # langs x dims numbers
        made.setdefault(r["lang"], np.zeros(space.dims))[r["pos"]] = r["v"]
    made = {k: v / n for k, v in sorted(made.items()) if (n := np.linalg.norm(v)) > 0}
    return Profiles(space, tuple(made), np.stack(list(made.values())) if made else np.zeros((0, space.dims)))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred (a learned language; `und` for a null text or one without a letter) and score (0 to 1, the
    cosine; 0 for `und`) added, or put in place of columns of these names. Only the text is looked at. Ties go to the
    language that sorts first. Repeated rows stay; an empty table stays empty."""
    p = profiles

    @F.arrow_udf("lang string, score double")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = p.space.letters()
        names = np.array([*p.langs, UNKNOWN], object)
        for s in parts:  # a batch stays in Arrow; only TEXTS of its texts are Python strings at once
            lang, score = [names[:0]], [np.zeros(0)]
            for at in range(0, len(s), TEXTS):
                texts = [t or "" for t in s.slice(at, TEXTS).to_pylist()]
                if not p.langs:
                    lang.append(np.full(len(texts), UNKNOWN, object))
                    score.append(np.zeros(len(texts)))
                    continue
                v, has = p.space.bundle(texts, held)
                norm = np.linalg.norm(v, axis=1)
                cos = (v @ p.prototypes.T) / np.where(norm > 0, norm, 1)[:, None]
                ok = has & (norm > 0)
                lang.append(names[np.where(ok, cos.argmax(axis=1), len(p.langs))])
                score.append(np.where(ok, cos.max(axis=1).clip(0, 1), 0.0))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(lang).tolist(), pa.string()), pa.array(np.concatenate(score).astype("f8"))], ["lang", "score"])

    return docs.withColumn("_siltmill_lid", predict("text")).withColumns({"lang_pred": F.col("_siltmill_lid.lang"), "score": F.col("_siltmill_lid.score")}).drop("_siltmill_lid")


def accepted(docs: DataFrame, profiles: Profiles, least: float = 0.05) -> DataFrame:
    """Rows of docs, all columns, that have a language: not `und`, and a cosine of at least `least` with a prototype.

    The bound is low on purpose: a clean text of one or two words has few n-grams and reaches 0.1 only."""
    name = "_siltmill_language"
    named = identify(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)), profiles)
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(f"{name}.*")
