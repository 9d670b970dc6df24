"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram of letters is the product
(binding) of its letters' vectors, each rotated (permuted) by its place. A text is the sum (bundle) of its
n-grams, a language the sum of its training texts, and a text has the language of the nearest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm._common import cut_lineage, free_name, slices

_SEED = 977
UNDETERMINED = "und"


class Profiles:
    """n-gram vectors of one size, bound from a table of letters when they are needed; holds ``most`` letters at most."""

    def __init__(self, dims: int, n: int, most: int = 4096):
        self.dims, self.n, self.most = dims, n, most
        self.slots: dict[int, int] = {}
        self.table = np.empty((n, 256, dims), np.int8)  # by place: each letter's vector, rotated by the place

    def letter(self, code: int) -> np.ndarray:
        return np.random.default_rng((_SEED, code)).integers(0, 2, self.dims, dtype=np.int8) * np.int8(2) - np.int8(1)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams packed with 21 bits a letter, a row each."""
        letters = keys[:, None] >> (21 * np.arange(self.n)) & 0x1FFFFF
        codes, at = np.unique(letters, return_inverse=True)
        new = [c for c in codes.tolist() if c not in self.slots]
        if len(self.slots) + len(new) > self.most:
            self.slots.clear()
            new = codes.tolist()
        while len(self.slots) + len(new) > self.table.shape[1]:
            self.table = np.concatenate((self.table, np.empty_like(self.table)), axis=1)
        for code in new:
            self.slots[code] = slot = len(self.slots)
            v = self.letter(code)
            for place in range(self.n):
                self.table[place, slot] = np.roll(v, place)
        slots = np.array([self.slots[c] for c in codes.tolist()], np.int64)[at.reshape(letters.shape)]
        out = self.table[0][slots[:, 0]]
        for place in range(1, self.n):
            out *= self.table[place][slots[:, place]]
        return out

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each (keys, counts) the sum of counts times vectors, a row each, in whole numbers."""
        keys, at = np.unique(np.concatenate([k for k, _ in texts]), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), [len(k) for k, _ in texts])
        counts = np.concatenate([c for _, c in texts])
        exact = np.float32 if not len(counts) or counts.sum() < 2**24 else np.float64
        out = np.zeros((len(texts), self.dims))
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(0, len(keys) + 1024, 1024))
        for k in range(len(first) - 1):
            some = order[first[k] : first[k + 1]]
            part = keys[1024 * k : 1024 * (k + 1)]
            dense = np.zeros((len(texts), len(part)), exact)
            dense[row[some], at[some] - 1024 * k] = counts[some]
            out += dense @ self.rows(part).astype(exact)
        return out


_letter = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """Which code points are letters, looked up once a worker."""
    if not _letter[ord("a")]:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for run in regex.finditer(r"\p{L}+", every):
            shift = [0x800 * (x >= 0xD800) for x in (run.start(), run.end() - 1)]
            _letter[run.start() + shift[0] : run.end() + shift[1]] = True
    return _letter


def grams(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a text's letters and their counts. Letters are lower-cased, other runs are one blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.int64) if text else np.empty(0, np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes[~letter] = 32
    codes = codes[np.concatenate(([True], letter[1:] | letter[:-1]))]  # of a run of others, the first
    keys = np.zeros(len(codes) - n + 1, np.int64)
    for place in range(n):
        keys |= codes[place : len(keys) + place] << (21 * place)
    return np.unique(keys, return_counts=True)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, n: int = 3) -> DataFrame:
    """lang and v, one prototype for each language: the sum over all its labelled texts, in whole numbers, so in any order alike.

    Rows with a null text or label are not used; a language whose texts have no letter has the prototype 0. Each task
    hands over one vector a language; these are summed by Spark in two steps. The result is cut off from its inputs.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Profiles(dims, n)
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

        for batch in batches:
            for part in slices(batch, 0, 4096):
                counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts.setdefault(lang, []).append(grams(text, n))
                for lang, own in counts.items():
                    keys, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                    total = np.bincount(at, np.concatenate([c for _, c in own]), len(keys))
                    sums[lang] = sums.get(lang, 0) + space.bundles([(keys, total)])[0]
                if len(sums) > 4096:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    def total(group: pa.Table) -> pa.Table:
        v = np.add.reduce([x.values.to_numpy() for x in group.column("v")])
        return group.slice(0, 1).set_column(group.schema.get_field_index("v"), "v", pa.array([v], pa.list_(pa.int64())))

    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    parts = rows.mapInArrow(partial, "lang string, v array<long>").withColumn("part", F.spark_partition_id() % 256)
    some = parts.groupBy("lang", "part").applyInArrow(total, parts.schema).drop("part")
    return cut_lineage(some.groupBy("lang").applyInArrow(total, some.schema))


class Scorer:
    """Nearest prototype of a text, among those of one block of languages. A worker frees its vectors at the task's end."""

    def __init__(self, prototypes: dict[str, np.ndarray], n: int):
        self.n = n
        self.names = [x for x in prototypes if np.linalg.norm(prototypes[x]) > 0]
        self.units = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in self.names])

    def __call__(self, texts: list[str | None], space: Profiles | None) -> list[tuple[str, float]]:
        found = [grams(t, self.n) for t in texts]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        some = [i for i, (keys, _) in enumerate(found) if len(keys)]
        for at in range(0, len(some) if self.names else 0, 128):
            rows = some[at : at + 128]
            v = space.bundles([found[i] for i in rows])
            size = np.sqrt((v * v).sum(axis=1))
            cosines = v @ self.units.T / np.maximum(size, 1e-300)[:, None]
            for i, best, cosine, norm in zip(rows, cosines.argmax(axis=1), cosines.max(axis=1), size, strict=True):
                if norm:
                    out[i] = self.names[best], min(1.0, max(0.0, float(cosine)))
        return out

    def space(self) -> Profiles | None:
        return Profiles(self.units.shape[1], self.n) if self.names else None


def scorers(prototypes: DataFrame, n: int = 3, block: int = 1000) -> list[Scorer]:
    """The languages in alphabetical order, so many to a scorer: what is sent to a task at once does not grow with them."""
    placed = prototypes.withColumn("place", F.row_number().over(Window.orderBy("lang")) - 1)
    blocks = -(-prototypes.count() // block)
    found = [placed.filter((F.col("place") >= k * block) & (F.col("place") < (k + 1) * block)).orderBy("place").collect() for k in range(blocks)]
    return [Scorer({r["lang"]: np.array(r["v"], float) for r in rows}, n) for rows in found]


def identify(docs: DataFrame, prototypes: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """id_col, lang_pred and score (cosine, 0 to 1) of every text; nothing but the text is looked at.

    Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was learned.
    Equal cosines go to the first language in alphabetical order. Very long texts are read whole. One row per input
    row, null and repeated ids too. Columns other than the two named are not read and may have any names. An empty table
    gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, t string, lang_pred string, score double"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    for scorer in scorers(prototypes, n):  # one for up to a thousand languages
        shared = docs.sparkSession.sparkContext.broadcast(scorer)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            score = shared.value
            space = score.space()
            for batch in batches:
                for part in slices(batch, 1, 1024):
                    before = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                    best = [new if new[1] > old[1] or old[0] == UNDETERMINED else old for old, new in zip(before, score(part.column(1).to_pylist(), space), strict=True)]
                    langs, scores = zip(*best, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "t", "lang_pred", "score"])

        out = out.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score")


def accepted(docs: DataFrame, prototypes: DataFrame, least: float, text_col: str = "text", n: int = 3) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: not ``und``, and a cosine of at least ``least``.

    Null, empty and letterless texts go; repeated rows are judged alike. An empty table gives an empty result.
    """
    name = free_name(docs, "accepted")
    out = docs.withColumn(name, F.lit(False))
    at = docs.columns.index(text_col)
    for scorer in scorers(prototypes, n):
        shared = docs.sparkSession.sparkContext.broadcast(scorer)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            score = shared.value
            space = score.space()
            for batch in batches:
                for part in slices(batch, at, 1024):
                    judged = [lang != UNDETERMINED and cosine >= least for lang, cosine in score(part.column(at).to_pylist(), space)]
                    known = pc.or_(part.column(part.num_columns - 1), pa.array(judged, pa.bool_()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], known], schema=part.schema)

        out = out.mapInArrow(run, out.schema)
    return out.filter(F.col(name)).drop(name)
