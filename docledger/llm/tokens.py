"""Token ids in directly addressable codes.

An id is cut into chunks of `CHUNK_BITS` bits, low chunk first. Level 0 holds the first chunk of all ids,
level k the k-th chunk of the ids that have one. A bitmap on each level says which ids go on, and a rank
directory counts the set bits before each group of 512, so any id is found by one look per level:
nothing before it is decoded. A file row is one segment: consecutive whole documents and their offsets.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import Scratch, ship, slices

CHUNK_BITS = 8
RANK_GROUP = 512
#: A segment ends with the first document that takes it to so many ids.
SEGMENT_IDS = 1 << 18
#: Texts whose words are numbered together: rows or, about, bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20

SEGMENT = (
    "part int, segment int, first_id long, n_ids long, doc_id array<long>, doc_end array<long>, "
    "chunks array<binary>, more array<binary>, ranks array<binary>"
)


def encode_dac(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of all levels of unsigned 32-bit ids."""
    chunks, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes())
        rest = rest >> CHUNK_BITS
        goes_on = rest > 0
        more.append(np.packbits(goes_on, bitorder="little").tobytes())
        counts = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_GROUP)) if len(goes_on) else []
        ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes() if len(counts) else b"")
        rest = rest[goes_on]
        if not len(rest):
            return chunks, more, ranks


class Dac:
    """Read access to the codes of a segment."""

    def __init__(self, chunks: list[bytes], more: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.more = [np.frombuffer(m, np.uint8) for m in more]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def __getitem__(self, i: int) -> int:
        """The id at a position, from one chunk per level."""
        value = 0
        for level, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << (CHUNK_BITS * level)
            bits = self.more[level]
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            group = i // RANK_GROUP
            first = group * RANK_GROUP // 8
            before = int(np.bitwise_count(bits[first : i >> 3]).sum())
            before += int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(self.ranks[level][group]) + before
        return value

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids of a range of positions; each level is entered at the rank of the range's start."""
        spans = []
        for level in range(len(self.chunks)):
            bits = self.more[level]
            flags = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")
            flags = flags[start - (start >> 3 << 3) :][: end - start].astype(bool)
            spans.append((self.chunks[level][start:end], flags))
            going = int(flags.sum())
            if not going:
                break
            group = start // RANK_GROUP
            before = np.unpackbits(bits[group * RANK_GROUP // 8 : (start + 7) >> 3], bitorder="little")
            start = int(self.ranks[level][group]) + int(before[: start - group * RANK_GROUP].sum())
            end = start + going
        high = np.zeros(0, np.uint32)
        for chunk, flags in reversed(spans):
            value = chunk.astype(np.uint32)
            value[flags] |= high << CHUNK_BITS
            high = value
        return high


_ENCODERS: dict = {}
#: Ends of words that are encoded apart from the letters before them: no rule of the vocabulary joins the two.
ENDS = ".,;:!?*#$%&)"
#: Letters that stay as they are in normal form and have a lower case of one letter in any context.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f]+"
#: Runs that are gathered at once.
GATHERED = 1 << 16
#: Words of letters that one call of the library takes, and other words.
WORDS_A_CALL, OTHERS_A_CALL = 1000, 10_000
#: The rules under which a word of letters in lower case is one piece, spelled in bytes.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = [
    {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
WORD_END = "</w>"
HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
SPELLED = {b: chr(256 + i) for i, b in enumerate(HIDDEN) if b != 0x20}


def joins_letters(rules: dict) -> bool:
    """Whether a tokenizer file has the rules above, so that words of letters need the model alone."""
    first, then, model = (rules.get(name) or {} for name in ("normalizer", "pre_tokenizer", "model"))
    others = [rules.get(name) for name in ("truncation", "padding", "post_processor")]
    others += [model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix")]
    return (
        first.get("normalizers") == NORMALIZER
        and then.get("pretokenizers") == PIECES
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == WORD_END
        and not any(others)
    )


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat`, whose lengths are `sizes`, that `which` names, behind each other, and their lengths."""
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    out = np.empty(int(lengths.sum()), flat.dtype)
    for i in range(0, len(which), GATHERED):  # places take several times the memory of what lies there
        some = slice(i, i + GATHERED)
        first, last = (int(ends[i] - lengths[i]), int(ends[some][-1]))
        place = np.repeat(starts[which[some]] - (ends[some] - lengths[some]), lengths[some])
        place += np.arange(first, last)
        out[first:last] = flat[place]
    return out, lengths


class Encoder:
    """Ids of whole texts, all from the tokenizers library.

    White space ends a token in this vocabulary, and so does the change from letters to the marks in
    `ENDS`. So Arrow cuts a batch of texts to words and numbers them, and each distinct word is encoded
    once: its letters by the library's model, many words a call, where the last token of each tells the
    words apart; its end, and any other word, by the whole tokenizer. The ids are gathered by number.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.joins = joins_letters(rules)
        if self.joins:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            vocabulary = rules["model"]["vocab"]
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        ids, ends = self.ids(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where those of each text end; a null text has none."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        counts = pc.list_value_length(words).to_numpy()
        numbered = words.flatten().dictionary_encode()
        del words  # the numbers and the distinct words are all that is read from here on
        ids, lengths = gather(*self._words(numbered.dictionary), numbered.indices.to_numpy())
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.cumsum(counts)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words behind each other, and their numbers."""
        bare = pc.utf8_rtrim(words, characters=ENDS)
        plain = pc.match_substring_regex(bare, LETTERS + "$") if self.joins else pa.array([False] * len(words))
        letters = pc.utf8_lower(pc.filter(bare, plain)).dictionary_encode()
        ends = pc.replace_substring_regex(pc.filter(words, plain), LETTERS, "").dictionary_encode()
        others = pc.filter(words, pc.invert(plain)).to_pylist()
        found = [
            self._letters(letters.dictionary.to_pylist()),
            self._whole(ends.dictionary.to_pylist()),
            self._whole(["", *others]),
        ]
        flat, sizes = (np.concatenate(x) for x in zip(*found))
        second, third = len(letters.dictionary), len(letters.dictionary) + len(ends.dictionary)
        is_plain = np.asarray(plain)
        parts = np.full((len(words), 2), third)  # the empty word
        parts[is_plain, 0] = letters.indices.to_numpy()
        parts[is_plain, 1] = ends.indices.to_numpy() + second
        parts[~is_plain, 0] = np.arange(len(others)) + third + 1
        ids, lengths = gather(flat, sizes, parts.ravel())
        return ids, lengths.reshape(-1, 2).sum(axis=1)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for words of letters in lower case."""
        calls = [" ".join(words[i : i + WORDS_A_CALL]) for i in range(0, len(words), WORDS_A_CALL)]
        spelled = [call.encode().decode("latin-1").translate(SPELLED) for call in calls]
        found = self.model.encode_batch_fast(spelled, add_special_tokens=False) if calls else []
        flat = np.concatenate([np.zeros(0, np.uint32), *[np.array(f.ids, np.uint32) for f in found]])
        ends = np.flatnonzero(self.ends_word[flat]) + 1 if len(flat) else np.zeros(0, np.int64)
        if len(ends) != len(words):  # a byte that the vocabulary lacks
            return self._whole(words)
        return flat, np.diff(ends, prepend=0)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for any words."""
        flat, sizes = [np.zeros(0, np.uint32)], []
        for i in range(0, len(words), OTHERS_A_CALL):
            for f in self.tokenizer.encode_batch_fast(words[i : i + OTHERS_A_CALL], add_special_tokens=False):
                flat.append(np.array(f.ids, np.uint32))
                sizes.append(len(f.ids))
        return np.concatenate(flat), np.array(sizes, np.int64)


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of all documents, each closed by `end_id`, as segments in ascending document order.

    `path` is a folder that all executors share; Spark writes it, so a lost task leaves nothing behind.
    Null texts are empty texts and give the end id alone; a null id comes first; rows with equal ids
    follow each other ordered by text; an empty table gives a folder without rows. Other columns are
    left out, whatever their names.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        names, ends, codes, size = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def closed() -> pa.RecordBatch:
            chunks, more, ranks = encode_dac(np.frombuffer(b"".join(codes), "<u4"))
            row = {
                "part": part, "segment": segment, "first_id": first, "n_ids": size, "doc_id": names,
                "doc_end": ends, "chunks": chunks, "more": more, "ranks": ranks,
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in slices(batches, BATCH_ROWS, BATCH_BYTES):
            ids, stops = encoder.ids(batch.column(1))
            for name, a, b in zip(batch.column(0).to_pylist(), [0, *stops], stops):
                codes += [ids[a:b].astype("<u4").tobytes(), end]
                size += int(b - a) + 1
                names.append(name)
                ends.append(size)
                if size >= segment_ids:
                    yield closed()
                    segment, first = segment + 1, first + size
                    names, ends, codes, size = [], [], [], 0
        if names:
            yield closed()

    schema = pa.schema(
        [("part", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64())]
        + [("doc_id", pa.list_(pa.int64())), ("doc_end", pa.list_(pa.int64()))]
        + [(n, pa.list_(pa.binary())) for n in ("chunks", "more", "ranks")]
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encoded, SEGMENT).write.option("compression", "zstd").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The segments with `start`: the ids of all segments before, in the order of the documents."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # One row for each range of documents, however many documents there are.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    # As many rows as the writer had range partitions: a setting, not a size of the data.
    with_start = segments.join(F.broadcast(starts), "part")
    return with_start.withColumn("start", F.col("part_start") + F.col("first_id")).drop("part_start")


def document_tokens(segments: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    ship(segments.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            codes = Dac(row["chunks"], row["more"], row["ranks"])
            ends = row["doc_end"]
            starts = [0, *ends[:-1]]
            sums = [zlib.crc32(codes.range(a, b).astype("<u4").tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_id"], pa.int64()),
                    pa.array([row["start"] + a for a in starts], pa.int64()),
                    pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    fields = ["start", "doc_id", "doc_end", "chunks", "more", "ranks"]
    return segments.select(*fields).mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, positions: DataFrame, position: str = "position") -> DataFrame:
    """The id at each wanted position of the whole corpus, without decoding a segment.

    One row per distinct position. Positions find their segment by a join on blocks of positions, so no
    segment meets positions that lie elsewhere, and a segment's set is bounded by its length; null
    positions and those outside the corpus are left out.
    """
    width = SEGMENT_IDS
    last = F.col("start") + F.col("n_ids") - 1
    blocks = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width)))
    held = segments.withColumn("block", blocks)
    wanted = positions.select(F.col(position).cast("long").alias("position"))
    wanted = wanted.withColumn("block", F.floor(F.col("position") / width))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") <= last)
    per_segment = (
        wanted.join(held.select("block", "part", "segment", "start", "n_ids"), "block")
        .where(inside)
        .groupBy("part", "segment", "start")
        .agg(F.collect_set(F.col("position") - F.col("start")).alias("i"))
    )

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            codes = Dac(row["chunks"], row["more"], row["ranks"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["start"] + i for i in row["i"]], pa.int64()),
                    pa.array([codes[i] for i in row["i"]], pa.int64()),
                ],
                names=["position", "token"],
            )

    codes = segments.select("part", "segment", "chunks", "more", "ranks")
    joined = per_segment.join(codes, ["part", "segment"])
    return joined.select("start", "i", "chunks", "more", "ranks").mapInArrow(looked_up, "position long, token long")


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of a table to the shared folder, and report from them per document."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = f"{scratch.root}/ids"
    write_tokens(docs, tokenizer, path, doc_id, text)
    return document_tokens(read_tokens(docs.sparkSession, path))



def default_tokenizer() -> str:
    """The public vocabulary file of the registered queries, found where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
