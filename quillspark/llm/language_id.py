"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams of the greatest size of which any is known, then shorter ones. A text's
language has the greatest sum; the score is its share under a softmax of the sums.

Words and n-grams are known by 64-bit hashes: the model is a sorted array of them beside a
matrix of log frequencies, and a slab of many texts is scored by array operations.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspark.llm.text_hash import U64, Quick, mix, slabs

SIZES = (5, 4, 3, 2, 1)
EDGES = (1, 2)  # stand for the start and the end of a word in its n-grams of two characters or more
COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("size", pa.int32()), ("n", pa.int64())])
SLAB_CHARS = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter (Unicode L), which numbers like superscripts are not."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _known_as(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of whole words (size 0) or n-grams, apart for each size."""
    return mix(hashes + U64(size * 0x9E3779B97F4A7C15 % (1 << 64)))


class Slab:
    """The words of some texts: runs of letters of the lower-cased text."""

    def __init__(self, texts: list[str], quick: Quick) -> None:
        low = [t.lower() for t in texts]
        self.quick = quick
        self.codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = _letters()[self.codes]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.cumsum([0] + [len(t) + 1 for t in low]))  # of each text, and the end
        self.hashes = _known_as(quick.ranges(self.codes.astype(U64), self.starts, self.ends), 0)

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into words) of each n-gram of the words, edges included where n > 1."""
        starts, sizes = self.starts[words], (self.ends - self.starts)[words]
        pad = int(n > 1)
        long = sizes + 2 * pad
        begins = np.cumsum(long) - long
        word = np.repeat(np.arange(len(words)), long)
        within = np.arange(len(word)) - begins[word]
        codes = self.codes[np.clip(starts[word] + within - pad, 0, len(self.codes) - 1)].astype(U64)
        if pad:
            codes[begins], codes[begins + long - 1] = EDGES
        real = np.flatnonzero(within[: len(word) - n + 1] + n <= long[word[: len(word) - n + 1]]) if len(word) >= n else np.zeros(0, np.int64)
        return _known_as(self.quick.fixed(codes, n)[real], n), word[real]


def _slabs(texts: list[str | None], quick: Quick):
    for lo, hi in slabs([len(t or "") for t in texts], SLAB_CHARS):
        yield lo, hi, Slab([t or "" for t in texts[lo:hi]], quick)


def _summed(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(hashes, return_inverse=True)
    return unique, np.bincount(at, weights=times, minlength=len(unique)).astype(np.int64)


def _count(batches):
    """Counts of words (size 0) and n-grams by language, summed within each batch first."""
    quick = Quick()
    for batch in batches:
        texts = batch["body"].to_pylist()
        langs = batch["lang"].dictionary_encode()
        found: dict[tuple[int, int], list] = {}
        for lo, hi, slab in _slabs(texts, quick):
            lang = np.repeat(langs.indices.to_numpy()[lo:hi], np.diff(slab.first))
            for k in np.unique(lang).tolist():
                mine = np.flatnonzero(lang == k)
                _, at, times = np.unique(slab.hashes[mine], return_index=True, return_counts=True)
                words = mine[at]
                found.setdefault((k, 0), []).append((slab.hashes[words], times))
                for n in SIZES:
                    hashes, of = slab.grams(words, n)
                    found.setdefault((k, n), []).append(_summed(hashes, times[of]))
        for (k, n), parts in found.items():
            hashes, times = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            size = len(hashes)
            yield pa.record_batch([pa.array([langs.dictionary[k].as_py()] * size, pa.string()), pa.array(hashes.view(np.int64)), pa.array(np.full(size, n, np.int32)), pa.array(times)], schema=COUNTS)


class Model:
    """Log frequency of each known word and n-gram in each language."""

    def __init__(self, langs: list[str], grams: np.ndarray, sizes: np.ndarray, counts: np.ndarray, totals: dict[int, list[int]]) -> None:
        """counts: a row for each gram, a column for each language; totals: by size, for each language."""
        by = np.argsort(grams)
        self.langs, self.keys = langs, grams[by]
        whole = np.array([totals.get(n, [0] * len(langs)) for n in range(max(SIZES) + 1)], dtype=np.float64)
        self.logs = np.log((counts[by] + 0.1) / (whole[sizes[by]] + 1.0)).astype(np.float32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def words(self, slab: Slab, words: np.ndarray) -> np.ndarray:
        """Log frequencies of distinct words: their own, or the mean over the longest known n-grams."""
        found = np.zeros((len(words), len(self.langs)))
        own = self.rows(slab.hashes[words])
        found[own >= 0] = self.logs[own[own >= 0]]
        left = np.flatnonzero(own < 0)
        for n in SIZES:
            if not len(left):
                break
            hashes, of = slab.grams(words[left], n)
            row = self.rows(hashes)
            of, row = of[row >= 0], row[row >= 0]
            times = np.bincount(of, minlength=len(left))
            for k in range(len(self.langs)):
                found[left, k] = np.bincount(of, weights=self.logs[row, k], minlength=len(left)) / np.maximum(times, 1)
            left = left[times == 0]
        return found

    def score(self, texts: list[str | None], quick: Quick | None = None) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = []
        for lo, hi, slab in _slabs(texts, quick or Quick()):
            _, at, of = np.unique(slab.hashes, return_index=True, return_inverse=True)
            logs = self.words(slab, at)
            text = np.repeat(np.arange(hi - lo), np.diff(slab.first))
            total = np.stack([np.bincount(text, weights=logs[of, k], minlength=hi - lo) for k in range(len(self.langs))], axis=1) if self.langs else np.zeros((hi - lo, 0))
            for sums, lettered in zip(total, np.diff(slab.first) > 0, strict=True):
                if not lettered or not self.langs:
                    out.append(("und", 0.0))
                else:
                    best = int(sums.argmax())
                    out.append((self.langs[best], float(1.0 / np.exp(sums - sums[best]).sum())))
        return out


def fold_of(doc_id: str) -> Column:
    """crc32 of the id's text modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def fit(rows: DataFrame, text: str, lang: str, key: str, per_lang: int = 4000, most_langs: int = 1000) -> Model:
    """Learns all words and n-grams of about ``per_lang`` rows of each language (all, where there are fewer).

    Of more than ``most_langs`` values of ``lang`` the most frequent are learned, at a tie the first by name,
    so a column of unclean values bounds neither the driver's memory nor the plan's width by its size.

    The sample is the rows whose hash of ``key`` falls below per_lang / count. That bound keeps
    the size of the model, 8 + 4 x languages bytes for each word or n-gram, apart from the size of the
    table; it grows with the number of languages. Rows without a key are not learned from.
    """
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    most = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    sizes = {r[0]: r[1] for r in most.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, U64), np.zeros(0, np.int32), np.zeros((0, 0)), {})
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(unit < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("body"))
    found = sample.mapInArrow(_count, "lang string, gram long, size int, n long")
    per = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, k in enumerate(langs)]
    known = found.groupBy("gram").agg(F.min("size").alias("size"), *per).toArrow()
    counts = np.stack([known[f"c{i}"].to_numpy() for i in range(len(langs))], axis=1)
    size = known["size"].to_numpy()
    totals = {n: counts[size == n].sum(axis=0).tolist() for n in (0, *SIZES)}
    return Model(langs, known["gram"].to_numpy().view(U64), size, counts, totals)


def annotate(docs: DataFrame, model: Model, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of docs, and two more: the predicted language and its score, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
    was learned. Words of unknown letters count for no language. At a tie the first language by
    name is predicted. Each row is judged by itself, whatever its id. An empty table gives an
    empty result. A column of docs that has one of the two new names is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_name, score_name)

    def run(batches):
        quick = Quick()
        for batch in batches:
            found = shared.value.score(batch[text].to_pylist(), quick)
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, lang_name, score_name])

    schema = StructType([*docs.schema, StructField(lang_name, StringType()), StructField(score_name, DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score for each row (see ``annotate``); only the named columns are read."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    return annotate(source, model, "body").select("id", "lang_pred", "score")
