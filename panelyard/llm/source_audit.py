"""How far the sources of a language diverge in the terms that they use.

Texts of a batch are read as one buffer of UTF-8 bytes: a lookup table lower-cases it and marks what is no letter, and
differences of the mark give the terms' boundaries. Slices are grouped by their xxHash and every group is compared
byte by byte, so terms that share a hash stay apart. Spark adds up the counts of (language, source, term), keeps the
terms that enough documents of the language hold, and deals them out in blocks. A block is a sparse matrix of sources
by terms in rows (CSR); sums of its segments give each pair of sources its part of the divergence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm._common import cut_lineage, passing_tables, slices, small, written

#: Byte -> the byte that stands for it in a term, lower-cased; 0 for ASCII that is no letter.
_LETTERS = np.array([i if i >= 128 else ord(chr(i).lower()) if chr(i).isalpha() else 0 for i in range(256)], np.uint8)


def slices_of(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the runs without a 0 in a buffer of texts that end at ``ends``; no run crosses a text's end."""
    inside = low != 0
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after[-1:], after[:-1] = False, inside[1:]
    cuts = ends[(ends > 0) & (ends < len(low))]
    before[cuts], after[cuts - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def group_slices(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """(number of each slice's term, the terms): slices have one number if and only if their bytes are equal."""
    data = low.tobytes()
    hashes = np.fromiter((digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = stops - starts
    model = first[group]
    differs = sizes != sizes[model]
    # bytes of each slice against those of the first one in its group
    same = np.flatnonzero(~differs & (model != np.arange(len(model))))
    if len(same):
        n = sizes[same]
        begins = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begins, n)
        unequal = low[np.repeat(starts[same], n) + inner] != low[np.repeat(starts[model[same]], n) + inner]
        differs[same] |= np.logical_or.reduceat(unequal, begins)
    terms = [data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
    if differs.any():  # terms that share a hash with another one get numbers of their own
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(differs).tolist():
            term = data[starts[i] : stops[i]]
            group[i] = more.setdefault(term, len(terms) + len(more))
        terms += more
    return group, terms


def _counted(texts: pa.Array, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(group * number of terms + term, occurrences, documents, terms) of non-null texts, text i in group of_text[i]."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    low = _LETTERS[data]
    starts, stops = slices_of(low, ends)
    term, terms = group_slices(low, starts, stops)
    doc = np.searchsorted(ends, starts, "right")
    held, times = np.unique(doc * len(terms) + term, return_counts=True)
    doc, term = np.divmod(held, max(len(terms), 1))
    keys, at = np.unique(of_text[doc] * len(terms) + term, return_inverse=True)
    return keys, np.bincount(at, times, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys)), terms


def term_counts(docs: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """lang, source, term, count (occurrences), docs (documents with it) of rows with text, lang and source; no nulls.

    Each most_bytes of text are counted apart: add up what belongs together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 65_536, most_bytes):
                lang, source = (c.dictionary_encode() for c in part.columns[1:])
                both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                keys, count, held, terms = _counted(part.column(0), both)
                group, term = np.divmod(keys, max(len(terms), 1))
                own_lang, own_source = np.divmod(group, len(source.dictionary))
                names = pa.array([t.decode() for t in terms], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(own_lang)), source.dictionary.take(pa.array(own_source)), names.take(pa.array(term)), pa.array(count), pa.array(held)],
                    names=["lang", "source", "term", "count", "docs"],
                )

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, count long, docs long")


def pair_sums(base: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each source i but the last: (i, the sum of \\|p_i - p_j\\| over the columns for each j > i), all in whole numbers.

    Source r has values at the given rows and columns, and base[r] at all its other columns.
    """
    order = np.lexsort((columns, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    pointers = np.searchsorted(rows, np.arange(len(base) + 1))
    filled = np.flatnonzero(np.diff(pointers))  # a segment must not be empty for reduceat
    for i in range(len(base) - 1):
        own = slice(pointers[i], pointers[i + 1])
        dense = np.full(n_columns, base[i])
        dense[columns[own]] = values[own]
        # as if each source had its base everywhere ...
        level = np.sort(values[own])
        below = np.concatenate(([0], np.cumsum(level)))
        k = np.searchsorted(level, base)
        total = base * k - below[k] + (below[-1] - below[k]) - base * (len(level) - k) + (n_columns - len(level)) * np.abs(base - base[i])
        # ... and what its own values change
        later = filled[filled > i]
        if len(later):
            start = pointers[later[0]]
            other = dense[columns[start:]]
            change = np.abs(values[start:] - other) - np.abs(base[rows[start:]] - other)
            total[later] += np.add.reduceat(change, pointers[later] - start)
        yield i, total[i + 1 :]


def _block_pairs(block: pa.Table) -> pa.Table:
    """lang, source, item, value of a block of one language's terms: rows with a term, and one without for each source."""
    lang = block.column("lang")[0].as_py()
    has_term = pc.is_valid(block.column("term"))
    sources, own = block.filter(pc.invert(has_term)), block.filter(has_term)
    sources = sources.take(pc.sort_indices(sources.column("source")))
    names = sources.column("source").combine_chunks()
    rows = np.asarray(pc.index_in(own.column("source"), value_set=names), np.int64)
    terms = own.column("term").combine_chunks().dictionary_encode()
    columns = np.asarray(terms.indices, np.int64)
    first, second, value = [], [], []
    for i, total in pair_sums(np.asarray(sources.column("p"), np.int64), rows, columns, np.asarray(own.column("p"), np.int64), len(terms.dictionary)):
        first.append(np.full(len(total), i))
        second.append(np.arange(i + 1, i + 1 + len(total)))
        value.append(total)
    join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
    first, second, value = join(first), join(second), join(value)
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": names.take(first), "item": names.take(second), "value": value})


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 n_terms)), exact for any counts."""
    wide = lambda c, digits=20: c.cast(f"decimal({digits},0)")
    return F.lit(1) + F.call_function("div", wide(F.lit(1_000_000_000), 10) * wide(count + 5), wide(total + 5 * n_terms))


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, block_values: int = 500_000
) -> DataFrame:
    """Divergence of the sources in each language: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the V terms that
    stand in least_docs of its documents. A group (language, source) and a language as a whole give each kept term
    p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the count's sum over the kept terms. Part ``pair`` has for every other source of
    the language (item) the sum of the differences of p over all kept terms; part ``term`` the top terms of
    the group that it holds and whose p is above the language's, with the difference. Ranks begin at 1 in each group and
    part, values descending, items ascending by their bytes.

    block_values: about how many counts one task compares at a time; results do not depend on it.
    Null texts, languages and sources are empty strings; groups without any term take part. Every row is a document, repeated ones too. Texts
    are read whole. Other columns are not read. An empty table gives an empty result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    with passing_tables(docs.sparkSession):
        groups = docs.select("lang", "source").distinct()
        # by language and term, so that one exchange serves the sums of a source and those of the language
        dealt = term_counts(docs).repartition("lang", "term")
        counts = dealt.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        kept = counts.withColumn("in_lang", F.sum("count").over(of_term)).withColumn("held", F.sum("docs").over(of_term))
        kept = written(kept.filter(F.col("held") >= least_docs).select("lang", "source", "term", "count", "in_lang"))

        terms = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"), F.count(F.lit(1)).alias("values"))
        langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_n"), F.sum("values").alias("values"))
        blocks = F.ceil(F.coalesce("values", F.lit(1)) / F.lit(block_values)).cast("int")
        langs = groups.select("lang").distinct().join(langs, "lang", "left").select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_n")], blocks.alias("blocks"))
        sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").withColumn("n", F.coalesce("n", F.lit(0)))
        groups = written(groups)

        own = kept.join(small(groups), ["lang", "source"])
        own = own.withColumn("p", _share(F.col("count"), F.col("n"), F.col("v"))).withColumn("q", _share(F.col("in_lang"), F.col("lang_n"), F.col("v")))
        above = own.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

        values = own.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
        base = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.greatest("v", F.lit(1)))).otherwise(0)  # p of a term that a source does not hold
        empty = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), base.alias("p"))
        parts = values.unionByName(empty).groupBy("lang", "block").applyInArrow(_block_pairs, "lang string, source string, item string, value long")
        pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b"))))
        pairs = pairs.select("lang", both.alias("s"), "value").select("lang", F.col("s.a").alias("source"), F.lit("pair").alias("part"), F.col("s.b").alias("item"), "value")

        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
        columns = ["lang", "source", "part", "item", "value"]
        return cut_lineage(above.select(*columns, place).filter(F.col("rank") <= top).unionByName(pairs.select(*columns, place)))
