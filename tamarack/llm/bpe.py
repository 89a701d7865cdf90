"""Operator 1: BPE encoding and decoding through a minimal acyclic transducer.

Words (pre-tokens) are counted over all documents.  The frequent ones, with their merged ids as
outputs, become a minimal acyclic transducer: common prefixes and suffixes share states, every arc
carries the number of words that sort before it, and the sum along a path is the word's place in
the id table.  Its arrays lie in one file that each worker maps into memory.  A batch's distinct
words walk through it in lockstep in numpy; words that it doesn't hold are merged exactly by rank,
so results never depend on which words are frequent.

Cases: very long texts, and words of any length, take time in proportion (times a logarithm), and some forty
times their size in a worker's memory; a null text is empty and has no tokens; the special token's string in a text becomes its
id, as the tokenizers library has it; repeated rows are encoded alike; other columns pass through,
and a column of the input named like an output column is replaced by the output; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import store
from tamarack.llm import textkit as tk

#: The split pattern published with the vocabulary, white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Letters and numbers newer than Unicode 16, which the tokenizers library doesn't take for such.
NEWER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    r"\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    r"\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_CAREFUL = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+| ?[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{NEWER}]]+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"
#: Below this lead byte, UTF-8 has none of the newer characters.
_NEWER_LEAD = 0xD5
#: Words in the transducer at most; the rest is merged, so this bounds memory and changes nothing else.
LEXICON_WORDS = 1 << 17
#: Longer words aren't in the transducer but always merged, so the words' number bounds its size.
LEXICON_CHARS = 64
#: Above this, words are merged one by one with a heap instead of all of one length together.
LOCKSTEP_BYTES = 40
_PLACE = (1 << 40) - 1
DECODE_ROWS = 256
MEMO_WORDS = 180_000


def default_vocabulary() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return os.path.join("/opt/tokenizers", "byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = ids[c]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        key = np.array(list(self.pairs), np.int64)
        order = np.argsort(key)
        self._key, self._rank = key[order], order  # ranks count the distinct pairs in the order of the file
        self._new = np.array([new for _, new in self.pairs.values()], np.int32)
        self._first = np.array(self.first, np.int32)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        n = self.lengths[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.pool[at].tobytes().decode("utf-8", "replace")

    def merge(self, word: bytes) -> list[int]:
        """Exact ids of one word: the pair of lowest rank, leftmost first, until none is left.

        A heap holds the pairs by rank and place, so the time is that of sorting, whatever the length."""
        pairs, n = self.pairs, len(word)
        ids = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (-1, 0)
        heap = [pair[0] << 40 | k for k in range(n - 1) if (pair := pairs.get(ids[k] << 32 | ids[k + 1], none)) is not none]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, k = top >> 40, top & _PLACE
            j = after[k]
            if ids[k] < 0 or j >= n:
                continue
            found, new = pairs.get(ids[k] << 32 | ids[j], none)
            if found != rank:  # one of the two has been merged since
                continue
            ids[k], ids[j] = new, -1
            after[k] = on = after[j]
            if on < n:
                before[on] = k
                if (pair := pairs.get(new << 32 | ids[on], none)) is not none:
                    heapq.heappush(heap, pair[0] << 40 | k)
            if (i := before[k]) >= 0 and (pair := pairs.get(ids[i] << 32 | new, none)) is not none:
                heapq.heappush(heap, pair[0] << 40 | i)
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words as bytes.  Words of one length are merged in lockstep: in every
        round each word that has a pair left merges one, so the unfinished ones stay equally wide."""
        out: list[bytes] = [b""] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lens).tolist():
            place = np.flatnonzero(lens == n)
            if n > LOCKSTEP_BYTES or n < 2:
                for i in place.tolist():
                    out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
                continue
            ids = self._first[np.frombuffer(b"".join([words[i] for i in place.tolist()]), np.uint8).reshape(-1, n)]
            found = self._lookup(ids[:, :-1], ids[:, 1:])
            while len(place):
                best = found.argmin(1) if found.shape[1] else np.zeros(len(place), np.int64)
                more = found[np.arange(len(place)), best] < len(self._key) if found.shape[1] else np.zeros(len(place), bool)
                raw, width = ids[~more].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, i in enumerate(place[~more].tolist()):
                    out[i] = raw[k * width : (k + 1) * width]
                place, ids, found, best = place[more], ids[more], found[more], best[more]
                if not len(place):
                    break
                row, at = np.arange(len(place)), np.arange(ids.shape[1] - 1)
                new = self._new[found[row, best]]
                ids = np.where(at <= best[:, None], ids[:, :-1], ids[:, 1:])
                ids[row, best] = new
                found = np.where(at[:-1] < best[:, None], found[:, :-1], found[:, 1:])
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < ids.shape[1] - 1)
                found[left, best[left] - 1] = self._lookup(ids[left, best[left] - 1], new[left])
                found[right, best[right]] = self._lookup(new[right], ids[right, best[right] + 1])
        return out

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; the number of merges if there is none."""
        want = a.astype(np.int64) << 32 | b
        k = np.minimum(np.searchsorted(self._key, want), len(self._key) - 1)
        return np.where(self._key[k] == want, self._rank[k], len(self._key))


# ---------------------------------------------------------------------------- the transducer


def build_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal automaton of sorted distinct words; an arc's output counts the words before it."""
    register: dict[tuple, int] = {}
    size: list[int] = []  # words accepted from each registered state
    arcs: list[tuple] = []
    path: list[list] = [[False, []]]  # unfinished states of the last word: [final, [(byte, target)]]

    def close(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if (n := register.get(key)) is None:
            n = register[key] = len(arcs)
            arcs.append(key)
            size.append(state[0] + sum(size[t] for _, t in state[1]))
        return n

    last = b""
    for word in words:
        k = 0
        while k < min(len(last), len(word)) and last[k] == word[k]:
            k += 1
        for at in range(len(last), k, -1):
            path[at - 1][1].append((last[at - 1], close(path.pop())))
        path.extend([False, []] for _ in range(len(word) - k))
        path[-1][0] = True
        last = word
    for at in range(len(last), 0, -1):
        path[at - 1][1].append((last[at - 1], close(path.pop())))
    root = close(path[0])
    key, target, out = [], [], []
    for n, (final, edges) in enumerate(arcs):
        before = int(final)
        for label, to in edges:
            key.append(n << 8 | label)
            target.append(to)
            out.append(before)
            before += size[to]
    return {
        "key": np.array(key, np.int64), "target": np.array(target, np.int32), "out": np.array(out, np.int32),
        "final": np.array([a[0] for a in arcs], np.uint8), "root": np.array([root], np.int64),
    }


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """One file: a line of JSON with names, types and places, then the arrays at multiples of 64."""
    spots, at = {}, 0
    for name, a in parts.items():
        spots[name] = [a.dtype.str, len(a), at]
        at += (a.nbytes + 63) // 64 * 64
    head = json.dumps(spots).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 64) for a in parts.values())


def mapped(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        head = f.readline()
    whole = np.memmap(path, np.uint8, "r")
    return {k: whole[len(head) + at : len(head) + at + n * np.dtype(d).itemsize].view(d) for k, (d, n, at) in json.loads(head).items()}


class Lexicon:
    """The mapped transducer with its table of ids."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.p = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word, or -1, all words walking one byte at a time together."""
        p = self.p
        lens = np.array([len(w) for w in words], np.int64)
        place = np.full(len(words), -1, np.int64)
        if not len(words) or not len(p["key"]):
            return place
        data, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens
        alive, state, total = np.flatnonzero(lens), None, np.zeros(len(words), np.int64)
        state = np.full(len(alive), int(p["root"][0]), np.int64)
        step = 0
        while len(alive):
            want = state << 8 | data[begin[alive] + step]
            k = np.minimum(np.searchsorted(p["key"], want), len(p["key"]) - 1)
            hit = p["key"][k] == want
            alive, k = alive[hit], k[hit]
            total[alive] += p["out"][k]
            state = p["target"][k].astype(np.int64)
            step += 1
            done = lens[alive] == step
            ended = alive[done]
            place[ended] = np.where(p["final"][state[done]], total[ended], -1)
            alive, state = alive[~done], state[~done]
        return place

    def ids(self, places: np.ndarray) -> list[bytes]:
        at = self.p["ids_at"]
        raw, lo, hi = self.p["ids"].data.cast("B"), (4 * at[places]).tolist(), (4 * at[places + 1]).tolist()
        return [bytes(raw[a:b]) for a, b in zip(lo, hi, strict=True)]


def build_lexicon(vocabulary: Vocabulary, words: list[str]) -> bytes:
    raw = sorted({w.encode() for w in words} - {b""})
    ids = vocabulary.merge_many(raw)
    at = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
    return pack(build_transducer(raw) | {"ids": np.frombuffer(b"".join(ids), "<u4"), "ids_at": at})


# ---------------------------------------------------------------------------- Spark side


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str], bool]]:
    """Some texts at a time: the first one's row, the texts, and whether they may hold characters of NEWER."""
    for lo, hi, data, _ in tk.blocks(column):
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()], bool(len(data)) and int(data.max()) >= _NEWER_LEAD


def _splitter(special: dict[str, int]):
    if not special:
        return lambda text: [text]
    inner = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    return lambda text: inner.split(text) if any(s in text for s in special) else [text]


def _finders():
    return regex.compile(PATTERN).findall, regex.compile(_CAREFUL).findall


def word_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents: counted in bounded maps in the tasks, then summed."""
    special = vocabulary.special

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, split = _finders(), _splitter(special)
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for _, texts, newer in _texts(batch.column(0)):
                for text in texts:
                    for k, part in enumerate(split(text)):
                        if not k % 2:
                            seen.update(find[newer](part))
                if len(seen) > 2 * MEMO_WORDS:
                    yield flush()
        if seen:
            yield flush()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tk.tidy(count), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words, as many whole counts as fit in ``limit``; what the driver gets is bounded by it."""
    table = store.write_table(counts.filter((F.col("n") >= 2) & (F.length("word") <= LEXICON_CHARS)), "words")
    tally = table.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    least, total = None, 0
    for row in tally:
        if (total := total + row["words"]) > limit:
            break
        least = row["n"]
    if least is None:
        return []
    return [r["word"] for r in table.filter(F.col("n") >= least).select("word").toLocalIterator()]


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoder(docs: DataFrame, vocabulary: Vocabulary, shared: Broadcast, text_col: str, lexicon_words: int) -> tuple[DataFrame, list[T.StructField], Run]:
    """What to send to the tasks, the columns that come back, and the function between."""
    spark: SparkSession = docs.sparkSession
    name = store.ship_bytes(spark, build_lexicon(vocabulary, frequent_words(word_counts(docs, vocabulary, text_col), lexicon_words)), "lexicon")
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids")]
    fields = [docs.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lexicon = shared.value, Lexicon(mapped(SparkFiles.get(name)))
        find, split = _finders(), _splitter(vocab.special)
        memo: dict[str, bytes] = {}

        def learn(new: list[str]) -> None:
            raw = [w.encode() for w in new]
            place = lexicon.find(raw)
            known, unseen = np.flatnonzero(place >= 0).tolist(), np.flatnonzero(place < 0).tolist()
            memo.update(zip([new[i] for i in known], lexicon.ids(place[known]), strict=True))
            memo.update(zip([new[i] for i in unseen], vocab.merge_many([raw[i] for i in unseen]), strict=True))

        for batch in batches:
            for lo, texts, newer in _texts(batch.column(len(rest))):
                parts = [[p if k % 2 else find[newer](p) for k, p in enumerate(split(t))] for t in texts]
                distinct = set().union(*(p for doc in parts for p in doc[::2]))
                if len(memo) + len(distinct) > 2 * MEMO_WORDS:
                    memo.clear()
                new = [w for w in distinct if w not in memo]
                learn(new)
                get = memo.__getitem__
                out = [b"".join(b"".join(map(get, p)) if not k % 2 else vocab.special[p].to_bytes(4, "little") for k, p in enumerate(doc)) for doc in parts]
                n = pa.array([len(x) // 4 for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(out)).columns[: len(rest)], n, pa.array(out, pa.binary())], names=[*rest, "n_tokens", "ids"])
                for w in new:
                    if len(w) > LEXICON_CHARS:
                        del memo[w]

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).cast("string").alias("_text")), fields, run


def _decoder(shared: Broadcast, names: list[str], ids_col: str) -> Run:
    where = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shared.value.text
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(lo, DECODE_ROWS)
                out = [text(np.frombuffer(x or b"", "<u4")) for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    return run


def _vocabulary(spark: SparkSession, path: str | None) -> tuple[Vocabulary, Broadcast]:
    store.ship_package(spark)
    vocabulary = Vocabulary(path or default_vocabulary())
    return vocabulary, spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary_path: str | None = None, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """All columns of ``docs`` but the text, with n_tokens (long) and ids (binary: little-endian unsigned 32-bit)."""
    sent, fields, run = _encoder(docs, *_vocabulary(docs.sparkSession, vocabulary_path), text_col, lexicon_words)
    return sent.mapInArrow(tk.tidy(run), T.StructType(fields))


def decode(encoded: DataFrame, vocabulary_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` with the decoded text; bytes that aren't UTF-8 become U+FFFD."""
    _, shared = _vocabulary(encoded.sparkSession, vocabulary_path)
    names = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in names] + [T.StructField("decoded", T.StringType())])
    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(tk.tidy(_decoder(shared, names, ids_col)), schema)


def digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, decoded and hashed in one worker."""
    vocabulary, shared = _vocabulary(docs.sparkSession, vocabulary_path)
    sent, fields, encoding = _encoder(docs.select("doc_id", "text"), vocabulary, shared, "text", LEXICON_WORDS)
    decoding = _decoder(shared, [f.name for f in fields], "ids")
    hexed = lambda column: pa.array([hashlib.sha256(x).hexdigest() for x in column.cast(pa.binary()).to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decoding(encoding(batches)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), hexed(b.column("ids")), hexed(b.column("decoded"))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([*fields[:2], T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return sent.mapInArrow(tk.tidy(run), schema)
