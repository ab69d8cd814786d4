"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are concatenated and cut into words (no piece reaches over a word's leading
spaces or a line feed); equal words are one entry. What is new among them is laid end to end; the
suffixes of that text are sorted, and a vectorised binary search finds each vocabulary piece's
range of occurrences. The ranges, sorted by position, are the edges of a lattice over all
words at once. Relaxing it for a BPE model repeats, for all words side by side: of the edges
that span exactly two current symbols, each word takes the one of best score, leftmost among
equals. Ids of words are kept within a task and copied to every occurrence by array
operations, as are the bytes of pieces in decoding. The vocabulary is read on the driver and
broadcast; its size is fixed.
"""

from __future__ import annotations

import string
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text_hash import slabs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 1 << 20
REMEMBERED = 250_000  # units kept with their ids
AT_ONCE = 30_000  # units in one suffix array
GAP = "▁"  # a space, in pieces
GAP_BYTES = GAP.encode()
LANES = 2  # 63-bit keys by which suffixes are sorted; what a longer piece has beyond them is compared after


@dataclass
class Vocabulary:
    """Pieces by id, their ranks (0 merges first), ids of the 256 byte pieces."""

    pieces: list[str]
    ranks: list[int]
    bytes_at: dict[int, int]
    unknown: int
    plain: list[int] = field(default_factory=list)  # ids of pieces that text can match

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        rank = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return Vocabulary([sp.id_to_piece(i) for i in range(n)], [rank[s] for s in scores], at, sp.unk_id(), [i for i in range(n) if not special[i]])


class Cutter:
    """Cuts UTF-8 text into units that are encoded by themselves, as no piece reaches over their ends.

    A unit starts at a run of spaces, at a line feed or NUL and behind it, and at a mark behind a letter,
    a digit or a byte beyond ASCII, if no piece has that mark in such a place.
    """

    def __init__(self, pieces: list[str]) -> None:
        if any(GAP in p.lstrip(GAP) or {"\n", "\0"} & set(p) for p in pieces):
            raise ValueError("a piece reaches over a word, a line feed or a NUL")
        joined = {b for p in pieces for a, b in zip(p, p[1:]) if a != GAP and (a.isalnum() or a > "\x7f")}
        self.mark, self.letter, self.alone = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
        self.mark[[ord(c) for c in string.punctuation if c not in joined]] = True
        self.letter[[*map(ord, string.ascii_letters + string.digits), *range(128, 256)]] = True
        self.alone[[0, 10]] = True

    def cut(self, bodies: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
        """The units, end to end, and the number of the first one of each body, and of the end."""
        data = b"".join(bodies)
        buf, begins = np.frombuffer(data, dtype=np.uint8), np.cumsum([0] + [len(b) for b in bodies])
        space, alone, head = buf == 32, self.alone[buf], np.zeros(len(buf) + 1, dtype=bool)
        head[1:-1] = space[1:] & ~space[:-1] | alone[1:] | alone[:-1] | self.mark[buf[1:]] & self.letter[buf[:-1]]
        head[begins] = True
        cuts = np.flatnonzero(head)
        units = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        return units, np.searchsorted(cuts, begins)


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.v = v
        self.forget()
        self.single = np.full(0x110000, -1, dtype=np.int32)  # ids of one-character pieces
        for i in v.plain:
            if len(v.pieces[i]) == 1:
                self.single[ord(v.pieces[i])] = i
        many = [i for i in v.plain if len(v.pieces[i]) > 1]
        self.cutter = Cutter([v.pieces[i] for i in many])
        self.ids, self.length = np.array(many), np.array([len(v.pieces[i]) for i in many])
        self.rank = np.array([v.ranks[i] for i in many])
        letters = sorted({c for i in many for c in v.pieces[i]})
        self.bits = (len(letters) + 1).bit_length()
        self.lane = 63 // self.bits
        self.dense = np.full(0x110000, len(letters) + 1, dtype=np.uint64)  # all characters outside pieces are alike
        self.dense[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.dense[0] = 0
        text = self.dense[[ord(c) for c in "\0".join(v.pieces[i] for i in many) + "\0"]]
        starts = np.cumsum(np.concatenate([[0], self.length[:-1] + 1])) if len(many) else np.zeros(0, np.int64)
        all_lanes = -(-int(self.length.max(initial=1)) // self.lane)
        keys = self._keys(text, starts, max(LANES, all_lanes))
        self.low, self.rest = keys[:LANES], keys[LANES:]
        self.high = [key | self._free(lane) for lane, key in enumerate(self.low)]

    def _free(self, lane: int) -> np.ndarray:
        """The bits of a lane that lie behind each piece's end."""
        free = np.clip(self.lane * (lane + 1) - self.length, 0, self.lane).astype(np.uint64) * np.uint64(self.bits)
        return (np.uint64(1) << free) - np.uint64(1)

    def _keys(self, codes: np.ndarray, starts: np.ndarray, lanes: int, first: int = 0) -> list[np.ndarray]:
        """The text from each start as numbers that compare as the text does; 0 ends a word."""
        padded = np.concatenate([codes, np.zeros((first + lanes) * self.lane, np.uint64)])
        found, live = [], np.ones(len(starts), dtype=bool)
        for j in range(first * self.lane):
            live &= padded[starts + j] > 0
        for lane in range(first, first + lanes):
            key = np.zeros(len(starts), dtype=np.uint64)
            for j in range(self.lane):
                c = padded[starts + lane * self.lane + j]
                live &= c > 0  # beyond the word's end nothing counts
                key = key << np.uint64(self.bits) | np.where(live, c, np.uint64(0))
            found.append(key)
        return found

    def _bound(self, suffixes: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """For each wanted key: how many suffixes are smaller (or, after, not greater)."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(suffixes[0]))
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, len(suffixes[0]) - 1)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for s, w in zip(suffixes, wanted, strict=True):
                x = s[mid]
                less |= same & (x < w)
                same &= x == w
                if not same.any():
                    break
            up = open_ & (less | same if after else less)
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return lo

    def edges(self, codes: np.ndarray):
        """(start, end, row in ids) of every occurrence of every piece, by position."""
        at = np.flatnonzero(codes)
        keys = self._keys(codes, at, LANES)
        order = np.lexsort(keys[::-1])
        suffixes = [k[order] for k in keys]
        first, stop = self._bound(suffixes, self.low, False), self._bound(suffixes, self.high, True)
        count = np.maximum(stop - first, 0)
        piece = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        start = at[order[first[piece] + within]]
        for lane, wanted in enumerate(self.rest, LANES):
            long = np.flatnonzero(self.length[piece] > lane * self.lane)
            if len(long):
                mine = piece[long]
                (key,) = self._keys(codes, start[long], 1, lane)
                free = self._free(lane)[mine]
                bad = (key | free) != (wanted[mine] | free)
                keep = np.ones(len(piece), dtype=bool)
                keep[long[bad]] = False
                piece, start = piece[keep], start[keep]
        by = np.argsort(start, kind="stable")
        return start[by].astype(np.int32), (start + self.length[piece])[by].astype(np.int32), piece[by].astype(np.int32)

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, end to end, and how many each has."""
        text = (b"\0".join(units) + b"\0").decode().replace(" ", GAP)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes, token = self.dense[points], self.single[points].astype(np.int64)
        alive = np.ones(len(codes) + 1, dtype=bool)  # a symbol starts here
        s, e, p = self.edges(codes)
        word = np.cumsum(codes == 0)[s]
        while len(s):
            count = np.cumsum(alive, dtype=np.int32)
            two = count[e - 1] - count[s] == 1
            best_of = np.where(two, self.rank[p], 1 << 29) << 32 | (s - s[0])
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(best_of, head)
            group = np.cumsum(np.concatenate([[False], word[1:] != word[:-1]]))
            take = np.flatnonzero(two & (best_of == least[group]))
            if not len(take):
                break
            begin = np.flatnonzero(alive)
            alive[begin[count[s[take]]]] = False  # the one boundary inside
            token[s[take]] = self.ids[p[take]]
            done = np.zeros(group[-1] + 1, dtype=bool)
            done[group[take]] = True
            keep = alive[s] & alive[e] & done[group]
            keep[take] = False
            s, e, p, word = s[keep], e[keep], p[keep], word[keep]
        ends = codes == 0
        symbol = np.flatnonzero(alive[:-1] & ~ends)
        found, size = token[symbol], np.ones(len(symbol), dtype=np.int64)
        odd = np.flatnonzero(found < 0)
        if len(odd):
            more = [self.fallback(text[k]) for k in symbol[odd].tolist()]
            size[odd] = [len(m) for m in more]
            strange = np.repeat(found < 0, size)
            found = np.repeat(found, size)
            found[strange] = list(chain.from_iterable(more))
        unit = (np.cumsum(ends) - ends)[symbol]
        return found, np.bincount(unit, weights=size, minlength=len(units)).astype(np.int64)

    def fallback(self, char: str) -> list[int]:
        """Byte pieces of a character outside the vocabulary, or the unknown id."""
        raw = char.encode("utf-8", "replace")
        return [self.v.bytes_at.get(b, self.v.unknown) for b in raw] if self.v.bytes_at else [self.v.unknown]

    def forget(self) -> None:
        """Only the NUL is known: it parts the units in ``learn``."""
        self.known = {b"\0": 0}  # places of units in starts and sizes
        self.flat = array("i", self.fallback("\0"))
        self.starts, self.sizes = array("q", [0]), array("q", [len(self.flat)])

    def remember(self, units: list[bytes]) -> np.ndarray:
        """Each unit's place in ``starts`` and ``sizes``; new units are encoded first."""
        fresh = [u for u in units if u not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = [u for u in units if u not in self.known]
        for at in range(0, len(fresh), AT_ONCE):
            some = fresh[at : at + AT_ONCE]
            ids, size = self.learn(some)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            self.starts.frombytes((len(self.flat) + np.cumsum(size) - size).tobytes())
            self.sizes.frombytes(size.tobytes())
            self.flat.frombytes(ids.astype(np.int32).tobytes())
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text. A text gets a space in front, as the model has it; an empty one none."""
        units, first = self.cutter.cut([b" " + t.encode().replace(GAP_BYTES, b" ") if t else b"" for t in texts])
        units = units.dictionary_encode()
        place = self.remember(units.dictionary.to_pylist())[units.indices.to_numpy()]
        ids, ends = gather(np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int64), np.frombuffer(self.sizes, np.int64), place)
        return pa.ListArray.from_arrays(pa.array(ends[first].astype(np.int32)), pa.array(ids))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + size] of each entry asked for, end to end, and where each begins."""
    size = sizes[of]
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(starts[of] - ends[:-1], size) + np.arange(ends[-1])], ends


class Decoder:
    """ids -> texts: pieces joined, byte pieces as bytes, without the leading space."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        table = [p.replace(GAP, " ").encode() for p in vocabulary.pieces]
        for b, i in vocabulary.bytes_at.items():
            table[i] = bytes((b,))
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def decode(self, rows: pa.ListArray) -> list[str | None]:
        offsets = rows.offsets.to_numpy()
        ids = rows.values.to_numpy()[offsets[0] : offsets[-1]]
        found, ends = gather(self.flat, self.starts, self.sizes, ids)
        data, cuts = found.tobytes(), ends[offsets - offsets[0]].tolist()
        texts = [data[a + data.startswith(b" ", a, b) : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t if valid else None for t, valid in zip(texts, rows.is_valid().to_pylist(), strict=True)] if rows.null_count else texts


ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encoded(batches, vocabulary: Vocabulary):
    """Batches of (id, body) as batches of (id, ids), of at most BATCH_CHARS characters each."""
    encoder = Encoder(vocabulary)
    for b in batches:
        texts = b["body"].to_pylist()
        for lo, hi in slabs([len(t or "") for t in texts], BATCH_CHARS):
            found = encoder.encode([t or "" for t in texts[lo:hi]])
            null = pa.array([t is None for t in texts[lo:hi]])
            found = pa.ListArray.from_arrays(found.offsets, found.values, mask=null) if null.true_count else found
            yield pa.record_batch([b["id"].slice(lo, hi - lo), found], schema=ENCODED)


def _decoded(batches, vocabulary: Vocabulary):
    """Batches of (id, ids) with the text of the ids."""
    decoder = Decoder(vocabulary)
    for b in batches:
        sizes = pc.list_value_length(b["ids"]).fill_null(0).to_pylist()
        for lo, hi in slabs(sizes, BATCH_CHARS):
            part = b.slice(lo, hi - lo)
            yield pa.record_batch([part["id"], part["ids"], pa.array(decoder.decode(part["ids"]), pa.string())], names=["id", "ids", "text"])


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))


def encode_docs(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ids array<int> for each row; a null text stays null, an empty one has no ids.

    Ids may be null or repeated. A literal U+2581 in a text is a space to the model and comes
    back as one. Only the named columns are read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        yield from _encoded(batches, shared.value)

    return _source(docs, doc_id, text).mapInArrow(run, "id long, ids array<int>")


def decode_docs(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """id, ids, text: the ids of ``encode_docs`` back as text; null stays null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        yield from _decoded(batches, shared.value)

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode_docs`` and ``decode_docs`` in one Python worker for each task, where two would hold twice the memory."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        yield from _decoded(_encoded(batches, shared.value), shared.value)
        pa.default_memory_pool().release_unused()

    return _source(docs, doc_id, text).mapInArrow(run, "id long, ids array<int>, text string")
