"""SentencePiece encoding and decoding by a relational lattice.

A text, with a space mark before it and for each space, is cut wherever no piece holds the two characters that meet
there: no piece spans such a cut, so the words between cuts can be encoded apart. (Marks are kept as plain spaces here,
which makes most words strings of one byte a character.) The lattice of all words: every
substring up to the longest piece is exploded and equi-joined to the piece table; the edges that result are grouped by
word, and a higher-order aggregate folds them to the path taken. A character without a piece of its own is an edge
without score and becomes byte pieces.

The fold is the one that the table's scores are made for. Scores of a unigram table are log-probabilities: the fold is
Viterbi's, place by place, the path with the highest sum; of equal sums the one whose last piece is longest. Scores of a
table of merges (BPE) are ranks, whose sums mean nothing: there the fold takes the edges in order of rank, then place,
and an edge replaces the pieces within it if both its ends are still ends of pieces. That is the merging itself, since
every piece of such a table is what its own text merges to: while its ends stand, nothing outside touches it.

Texts are read once. A task cuts its texts into words and numbers the words of each ``CHUNK`` characters; it writes
a row for each such chunk: its words, and for every place in its texts the number of the word there. The words of all
chunks meet by word, each is encoded once, and its ids go back to the chunks that have it. The rows of chunks are in
buckets by chunk, so they are not shuffled; a task puts a chunk's ids together by their numbers. So what is shuffled
is the distinct words of chunks, and their ids.

A word of over ``LONGEST`` characters (a run that no cut divides) is encoded by the same rule in the task that has its
chunk, since its edges would be one row too large for a fold.

Defined results: a null text counts as empty and has no pieces; a mark (U+2581) in a text decodes to a space, as with
the library; repeated rows give a row each; an empty table gives no row; a text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, shuffle_partitions

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 1 << 18
#: Characters whose distinct words are numbered together, and those that are cut at once.
CHUNK = 1 << 24
_PART = 1 << 20
#: Words whose ids are put together at once.
_PLACES = 1 << 20
LONGEST = 4096
_INNER = -(1 << 31)
_FEW = 0x250


@dataclass(frozen=True)
class Pieces:
    """pieces: text -> (id, score); joined: pairs of characters that some piece holds; raw: what each id decodes to; byte_ids: ids of the 256 byte pieces; unknown: the penalty; merges: whether scores are ranks of merges."""

    pieces: dict[str, tuple[int, float]]
    joined: frozenset[str]
    raw: list[bytes]
    byte_ids: list[int]
    unknown: float
    longest: int
    merges: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        table, raw, byte_ids = {}, [], [0] * 256
        for k, p in enumerate(model.pieces):
            text = p.piece.replace(MARK, " ")
            raw.append(text.encode() if p.type in (1, 4) else b"")
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = k
                raw[k] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (1, 4):
                table[text] = (k, float(p.score))
        return cls.of(table, raw, byte_ids, model.trainer_spec.model_type == 2)

    @classmethod
    def of(cls, table: dict[str, tuple[int, float]], raw: list[bytes], byte_ids: list[int], merges: bool) -> Pieces:
        joined = frozenset(p[k : k + 2] for p in table for k in range(len(p) - 1))
        if len(table) >= 1 << 20 or max(map(len, table)) > 63:
            raise ValueError("a table of over a million pieces, or a piece of over 63 characters")
        if any(pair[1] == "\n" for pair in joined):
            raise ValueError("a piece spans the start of a line")
        return cls(table, joined, raw, byte_ids, min(s for _, s in table.values()) - 10, max(map(len, table)), merges)


class Cutter:
    """Cuts texts into words: between characters that no piece holds together."""

    def __init__(self, joined: frozenset[str]):
        first, second = ({c: k for k, c in enumerate(sorted({p[at] for p in joined}), 1)} for at in (0, 1))
        self.first, self.second = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        for of, numbers, step in ((self.first, first, len(second) + 1), (self.second, second, 1)):
            of[[ord(c) for c in numbers]] = [k * step for k in numbers.values()]
        self.apart = np.ones((len(first) + 1) * (len(second) + 1), bool)
        self.apart[[self.first[ord(p[0])] + self.second[ord(p[1])] for p in joined]] = False

    def __call__(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, one after the other, and how many each text has; an empty text has none."""
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        whole = "".join(x for t in texts if t for x in (" ", t)).replace(MARK, " ")
        chars, body = np.frombuffer(whole.encode("utf-32-le"), "<u4"), whole.encode()
        starts = np.ones(len(chars) + 1, bool)
        if len(chars):
            starts[1:-1] = self.apart[self.first[chars[:-1]] + self.second[chars[1:]]]
        text_starts = np.cumsum(sizes) - sizes
        starts[text_starts] = True
        at = np.flatnonzero(starts)
        n_words = np.diff(np.searchsorted(at, np.append(text_starts, len(chars))))
        if len(body) > len(chars):
            at = np.concatenate(([0], np.cumsum(1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000))))[at]
        words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(body))
        return words.dictionary_encode(), n_words


def merged(word: str, table: Pieces) -> list[str]:
    """The merges of one long word: best rank first, of equal ones the leftmost."""
    n, get = len(word), table.pieces.get
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and end[b] - a <= table.longest and (own := get(word[a : end[b]])):
            heapq.heappush(heap, (-own[1], a, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, to = heapq.heappop(heap)
        b = after[a]
        if end[a] == 0 or b >= n or end[b] != to:
            continue
        end[a], after[a], end[b] = to, after[b], 0
        if after[a] < n:
            before[after[a]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [word[a : end[a]] for a in range(n) if end[a]]


def best_path(word: str, table: Pieces) -> list[str]:
    """Viterbi's path of one long word."""
    n = len(word)
    score, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for b in range(1, n + 1):
        for a in range(max(0, b - table.longest), b):
            own = table.pieces.get(word[a:b]) or ((-1, table.unknown) if b - a == 1 else None)
            if own and score[a] + own[1] > score[b]:
                score[b], back[b] = score[a] + own[1], a
    out: list[str] = []
    while n:
        out.append(word[back[n] : n])
        n = back[n]
    return out[::-1]


def ids_of(word: str, table: Pieces) -> list[int]:
    """What encode_words() gives, for one word."""
    parts = (merged if table.merges else best_path)(word, table)
    return [k for p in parts for k in ([table.pieces[p][0]] if p in table.pieces else [table.byte_ids[c] for c in p.encode("utf-8", "replace")])]


def _viterbi(n, score_of):
    """ids of the column edges: the best sum of scores, place by place; a character alone is minus its place."""
    start = F.struct(F.array(F.lit(0.0)).alias("score"), F.array(F.array().cast("array<int>")).alias("path"))

    def step(acc, b):
        longer = F.transform(F.filter("edges", lambda e: e["b"] == b), lambda e: F.struct(e["a"].alias("a"), e["id"].alias("id"), e["score"].alias("score")))
        ends = F.concat(F.array(F.struct(b.alias("a"), (-b).alias("id"), score_of(b).alias("score"))), longer)
        best = F.array_max(F.transform(ends, lambda e: F.struct((F.element_at(acc["score"], e["a"]) + e["score"]).alias("score"), (-e["a"]).alias("a"), e["id"].alias("id"))))
        return F.struct(F.array_append(acc["score"], best["score"]).alias("score"), F.array_append(acc["path"], F.array_append(F.element_at(acc["path"], -best["a"]), best["id"])).alias("path"))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: F.element_at(acc["path"], -1))


def _merging(n):
    """ids of the column edges, packed numbers in order of rank and place: at each place the id of the piece that starts there, or _INNER; a character alone is minus its place."""
    inner = F.lit(_INNER)
    bits = lambda e, at, size: F.shiftright(e, at).bitwiseAND(F.lit((1 << size) - 1)).cast("int")
    unpacked = F.transform("edges", lambda e: F.struct(bits(e, 30, 13).alias("a"), (bits(e, 30, 13) + bits(e, 24, 6)).alias("b"), bits(e, 0, 24).alias("id")))

    def step(acc, e):
        ends = (F.element_at(acc, e["a"]) != inner) & ((e["b"] == n) | (F.element_at(acc, F.least(e["b"] + 1, n)) != inner))
        join = lambda x, k: F.when(k + 1 == e["a"], e["id"]).when((k + 1 > e["a"]) & (k < e["b"]), inner).otherwise(x)
        return F.when(ends, F.transform(acc, join)).otherwise(acc)

    return F.filter(F.aggregate(unpacked, F.transform(F.sequence(F.lit(1), n), lambda a: -a), step), lambda x: x != inner)


def encode_words(words: DataFrame, table: Pieces) -> DataFrame:
    """words: distinct column word, not empty, dealt by word. (word, ids).

    The piece table is a parameter of fixed size. Edges are grouped where their word is: explode and broadcast join keep
    the partitioning by word. Characters alone are edges of every lattice; they are looked up where the fold takes them,
    so that only pieces of two characters and more are exploded and joined.
    """
    rank = {s: r for r, s in enumerate(sorted({-s for _, s in table.pieces.values()}))}
    pieces = F.broadcast(words.sparkSession.createDataFrame([(p, k, s, rank[-s]) for p, (k, s) in table.pieces.items() if len(p) > 1], "piece string, id int, score double, rank long"))
    n = F.length("word")
    last = F.least(n, F.col("a") + table.longest - 1)
    ends = F.when(F.col("a") == 1, F.sequence(F.lit(1), last)).when(F.col("a") < n, F.sequence(F.col("a") + 1, last))  # the first character stands for its word
    starts = words.withColumn("a", F.explode(F.sequence(F.lit(1), n)))
    parts = starts.withColumn("b", F.explode(ends)).withColumn("piece", F.expr("substring(word, a, b - a + 1)"))
    edges = parts.join(pieces, "piece", "left").where("id IS NOT NULL OR b = 1")
    a, size = F.col("a").cast("long"), (F.col("b") - F.col("a")).cast("long")
    packed = F.shiftleft("rank", 43) + F.shiftleft(a, 30) + F.shiftleft(size, 24) + F.col("id")  # 20 bits of rank, 13 of place, 6 of length, 24 of id
    edge = packed if table.merges else F.struct("b", "a", "id", "score")
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), edge))).alias("edges"))

    # Ids and scores of characters: by code point below _FEW, the others by their place in a string.
    others = sorted(c for c in table.pieces if len(c) == 1 and ord(c) >= _FEW)
    alone = [table.pieces.get(c, (_INNER, table.unknown)) for c in (*map(chr, range(_FEW)), *others)]
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    ids, scores, byte_ids = listed([k for k, _ in alone], "int"), listed([s for _, s in alone], "double"), listed(table.byte_ids, "int")

    def at(place):
        c = F.substring("word", place, F.lit(1))
        far = F.instr(F.lit("".join(others)), c)
        return F.when(F.ascii(c) < _FEW, F.ascii(c) + 1).when(far > 0, far + _FEW)

    def pieces_of(place):
        c = F.encode(F.substring("word", place, F.lit(1)), "utf-8")
        each = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda k: F.element_at(byte_ids, F.conv(F.hex(F.substring(c, k, F.lit(1))), 16, 10).cast("int") + 1))
        own = F.element_at(ids, at(place))
        return F.when(own >= 0, F.array(own)).otherwise(each)

    fold = _merging(n) if table.merges else _viterbi(n, lambda place: F.coalesce(F.element_at(scores, at(place)), F.lit(table.unknown)))
    whole = F.flatten(F.transform("ids", lambda k: F.when(k >= 0, F.array(k)).otherwise(pieces_of(-k))))
    return lattice.select("word", fold.alias("ids")).select("word", F.when(F.exists("ids", lambda k: k < 0), whole).otherwise(F.col("ids")).alias("ids"))


def shrunk(numbers: np.ndarray) -> bytes:
    """Packed: the lowest bytes of all numbers, then the next ones, by zstd."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def grown(body: bytes) -> np.ndarray:
    """The numbers that shrunk() packed, below 2**31."""
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1).T).view("<i4").ravel()


_CHUNKS = "chunk long, doc_ids array<long>, n_words array<int>, places binary, words array<string>, long_words array<struct<k: int, word: string>>"


def _chunks(joined: frozenset[str], most: int, longest: int):
    """Rows _CHUNKS: words that are not too long by number, frequent ones first, the others with their numbers; places: the packed number of each place's word."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, task = Cutter(joined), TaskContext.get().partitionId()
        doc_ids, texts, parts, counts, size, held, n = [], [], [], [], 0, 0, 0

        def cut_part() -> None:
            nonlocal held
            words, n_words = cut(texts)
            parts.append(words)
            counts.append(n_words)
            texts.clear()
            held = 0

        def out() -> pa.RecordBatch:
            nonlocal size, n
            whole = pa.chunked_array(parts).unify_dictionaries()
            places = np.concatenate([x.indices.to_numpy() for x in whole.chunks])
            words = whole.chunk(0).dictionary
            by_count = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.int32)
            number[by_count] = np.arange(len(words), dtype=np.int32)
            words = words.take(pa.array(by_count))
            too_long = pc.greater(pc.utf8_length(words), longest)
            far = [{"k": k, "word": words[k].as_py()} for k in np.flatnonzero(too_long.to_numpy(zero_copy_only=False)).tolist()]
            row = {
                "chunk": pa.array([task << 32 | n], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "n_words": pa.array([np.concatenate(counts)], pa.list_(pa.int32())),
                "places": pa.array([shrunk(number[places])], pa.binary()),
                "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pc.if_else(too_long, None, words).cast(pa.string())),
                "long_words": pa.array([far], pa.list_(pa.struct([("k", pa.int32()), ("word", pa.string())]))),
            }
            for own in (doc_ids, parts, counts):
                own.clear()
            size, n = 0, n + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                doc_ids.append(doc_id)
                texts.append(text)
                size, held = size + len(text) + 1, held + len(text) + 1
                if held >= min(_PART, most):
                    cut_part()
                if size >= most:
                    if texts:
                        cut_part()
                    yield out()
        if texts:
            cut_part()
        if doc_ids:
            yield out()

    return chunks


def frequent_words(docs: DataFrame, table: Pieces, most: int = FREQUENT) -> DataFrame:
    """docs: doc_id, text. The words that are in the most chunks. encode() needs no such list: each word is encoded once."""
    words = docs.select("doc_id", "text").mapInArrow(_chunks(table.joined, CHUNK, LONGEST), _CHUNKS).select(F.explode("words").alias("word"))
    return words.where("word IS NOT NULL").groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).select("word")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (chunk, k, ids): for each chunk the numbers of words, how many ids each has, and the ids; packed."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        ids, chunk, k = rows["ids"].combine_chunks(), rows["chunk"].to_numpy(), rows["k"].to_numpy()
        order = np.lexsort((k, chunk))
        sizes = ids.value_lengths().to_numpy()
        (values, ends), chunk, k, sizes = gathered(ids.flatten().to_numpy(), sizes, order), chunk[order], k[order], sizes[order]
        firsts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
        ends, cuts = np.concatenate(([0], ends)), [*firsts.tolist(), len(chunk)]
        packed = [(shrunk(k[a:b]), shrunk(sizes[a:b]), shrunk(values[ends[a] : ends[b]])) for a, b in zip(cuts, cuts[1:])]
        return pa.record_batch([pa.array(chunk[firsts]), *(pa.array(x, pa.binary()) for x in zip(*packed))], names=["of", "ks", "sizes", "ids"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _PLACES:
            yield out(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield out(pa.Table.from_batches(held))


def _joiner(table, then=None):
    """Of a chunk's coded words, packed, and its row: doc_id, ids; a row for each text. then: what follows, batch by batch."""

    def join(coded: pa.Table, chunk: pa.Table) -> pa.Table:
        row = chunk.combine_chunks().to_batches()[0]
        doc_ids, n_words, far = (row.column(name).flatten() for name in ("doc_ids", "n_words", "long_words"))
        places = grown(row.column("places")[0].as_buffer())
        own = [ids_of(w, table.value) for w in far.field("word").to_pylist()]
        k, sizes, values = (np.concatenate([*(grown(x.as_buffer()) for x in coded[name]), np.array(more, np.int32)]) for name, more in (("ks", far.field("k").to_pylist()), ("sizes", list(map(len, own))), ("ids", [x for ids in own for x in ids])))
        order = np.argsort(k)
        if not np.array_equal(k[order], np.arange(int(places.max()) + 1 if len(places) else 0)):
            raise RuntimeError("a chunk whose words are not all there once")
        values, sizes = gathered(values, sizes, order)[0], sizes[order]
        ends, a, out = np.concatenate(([0], np.cumsum(n_words.to_numpy(), dtype=np.int64))), 0, []
        while a < len(doc_ids):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _PLACES, "right")) - 1)
            got, places_end = gathered(values, sizes, places[ends[a] : ends[b]])
            text_ends = np.concatenate(([0], places_end))[ends[a : b + 1] - ends[a]]
            out.append(pa.record_batch([doc_ids[a:b], pa.ListArray.from_arrays(pa.array(text_ends, pa.int32()), pa.array(got))], names=["doc_id", "ids"]))
            a = b
        return pa.Table.from_batches(list(then(out)) if then else out)

    return join


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, ids."""
    table = Pieces.load(model)
    return _by_chunk(docs, id_col, text_col, table).applyInArrow(_joiner(docs.sparkSession.sparkContext.broadcast(table)), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """decode() of encode(), in one Python worker a task instead of two: doc_id, ids, text."""
    table = Pieces.load(model)
    join = _joiner(docs.sparkSession.sparkContext.broadcast(table), _decoder(table.raw))
    return _by_chunk(docs, id_col, text_col, table).applyInArrow(join, "doc_id long, ids array<int>, text string")


def _by_chunk(docs: DataFrame, id_col: str, text_col: str, table: Pieces):
    """What _joiner() takes: by chunk, its coded words, packed, and its row."""
    n = shuffle_partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = bucketed(own.mapInArrow(_chunks(table.joined, CHUNK, LONGEST), _CHUNKS), "chunk", n)
    words = chunks.select("chunk", F.posexplode("words").alias("k", "word")).where("word IS NOT NULL").repartition(n, "word")
    each = words.groupBy("word").agg(F.min(F.col("chunk") + F.col("k")).alias("least")).where("least >= 0").select("word")  # reads all columns, so that it shares the join's shuffle
    coded = words.join(encode_words(each, table).hint("merge"), "word").select("chunk", "k", "ids").mapInArrow(_pack, "of long, ks binary, sizes binary, ids binary")
    return coded.groupBy("of").cogroup(chunks.select("chunk", "doc_ids", "n_words", "places", "long_words").groupBy("chunk"))


def gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values holds runs of the given sizes. The runs at the given places one after the other, and where each ends."""
    starts, own = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[at] - (ends - own), own) + np.arange(total)], ends


def _decoder(raw: list[bytes]):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw)), np.int64)
        for batch in batches:
            ids, a = batch.column(1), 0
            while a < batch.num_rows:  # a part holds some hundred thousand ids
                b, held = a, 0
                while b < batch.num_rows and (held < 1 << 18 or b == a):
                    held += len(ids[b].values) if ids[b].is_valid else 0
                    b += 1
                part = ids.slice(a, b - a)
                text, ends = gathered(flat, sizes, part.flatten().to_numpy())
                ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(part.value_lengths().fill_null(0).to_numpy())))].tolist()
                whole = text.tobytes()
                texts = [whole[x + 1 : y].decode("utf-8", "replace") for x, y in zip(ends, ends[1:])]
                yield pa.record_batch([batch.column(0).slice(a, b - a), part, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                a = b

    return decode


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded: doc_id, ids. The same with text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(Pieces.load(model).raw), "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids joined by commas), decoded_sha256, n_chars of what decodes."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"), F.length("text").cast("long").alias("n_chars"))
