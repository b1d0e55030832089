"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut into words wherever no piece of the model holds the two characters
side by side, so that no piece spans two words: before word marks, and mostly
around signs, digits and line breaks.  The distinct words of a batch are sorted and
traversed depth-first as a trie: the forward state of a prefix (best piece that
ends there, its score, and the vocabulary nodes that are still open) is computed
once for all words that begin with it.

Two kinds of models share the traversal and differ in the choice at a position:

* unigram: the piece with the best score of its prefix plus its own (Viterbi);
* BPE: merging by rank isn't a best sum of scores, so a Viterbi choice would not
  give the model's own result.  For BPE the last piece of a prefix is the piece
  that ends there and may follow the last piece before it, where two pieces may
  stand side by side if merging their joined text gives back just these two;
  that is found by undoing their own merges, latest first.
  Exactly one piece fulfils that, so the forward pass stays one.

A model is a file in the public binary format; its path is a parameter, and its
bytes (under MAX_MODEL) are broadcast.
"""

from __future__ import annotations

import math
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hand_back, ship, small_batches

MARK = "▁"
MAX_MODEL = 64 << 20
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a worker keeps between batches (and twice as many pairs of pieces): some 40 MB, dropped when its task ends.
KEPT = 150_000
#: Characters of a word that may be kept.
LONG = 32
#: Classes of characters by which a text is cut.
CLASSES = 1024


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a message in the protocol buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.byte_fallback, self.dummy_prefix, charsmap, squeeze = UNIGRAM, False, True, b"", True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        squeeze = bool(v)
        if charsmap or squeeze:
            raise ValueError("only models with the identity normaliser that keep extra white space are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if any(k == USER_DEFINED for k in self.kinds):
            raise ValueError("user-defined pieces are not supported")
        low = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.unknown_score = low - 10.0
        self.plain = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        if UNKNOWN in self.kinds:
            self.plain[self.unknown] = " ⁇ ".encode()


def merge(model: Model, text: str, least: int = 1) -> list[str]:
    """BPE by its definition: join the adjacent pair whose joined piece scores best, leftmost first, while there is one (and more than least parts)."""
    parts = list(text)
    while len(parts) > least:
        best = None
        for i in range(len(parts) - 1):
            piece = model.ids.get(parts[i] + parts[i + 1])
            if piece is not None and (best is None or model.scores[piece] > best[0]):
                best = (model.scores[piece], i)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Encoder:
    """Encodes sorted words depth-first over the vocabulary's trie.

    Nodes of the trie are numbers.  With the links to the node of the longest proper suffix (fail), one
    node stands for all vocabulary nodes that are open after a prefix; ends lists the pieces that end there.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.size = [len(p) for p in model.pieces]
        #: For BPE, the two pieces that a piece was last merged from, where each merge in it scores below those before it.
        self.split: dict[int, tuple[int, int]] = {}
        self.orderly: set[int] = set()
        self.next: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        for piece, i in sorted(model.ids.items(), key=lambda x: len(x[0])):
            if model.kind == BPE and not self._arises(piece, i):
                continue
            node = 0
            for c in piece:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(own)
                    self.next.append({})
                    own.append(-1)
                node = to
            own[node] = i
        self.fail = [0] * len(own)
        self.ends: list[tuple[int, ...]] = [()] * len(own)  # longest first
        level = [0]
        while level:
            for node in level:
                for c, to in self.next[node].items():
                    at = self.fail[node]
                    while at and c not in self.next[at]:
                        at = self.fail[at]
                    at = self.next[at].get(c, 0) if node else 0
                    self.fail[to] = at
                    self.ends[to] = self.ends[at] if own[to] < 0 else (own[to], *self.ends[at])
            level = [to for node in level for to in self.next[node].values()]
        self.class_of, self.apart = self._classes()
        self.pairs: dict[int, bool] = {}  # by the first piece times the number of pieces plus the second
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers

    def _classes(self) -> tuple[np.ndarray, np.ndarray]:
        """A class for every code point, and whether a text may be cut between characters of two classes.

        It may be where no piece holds the two side by side.  Class 0 has the characters in no piece, class 1 those in pieces
        of one character only.  The others share what is left: where classes are shared, fewer cuts are made.
        """
        ids = self.model.ids
        beside = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        class_of = np.zeros(sys.maxunicode + 1, np.uint16)
        for c in ids:
            if len(c) == 1:
                class_of[ord(c)] = 1
        for i, c in enumerate(sorted(set().union(*beside))):
            class_of[ord(c)] = 2 + i % (CLASSES - 2)
        apart = np.ones((CLASSES, CLASSES), bool)
        for pair in beside:
            apart[class_of[ord(pair[0])], class_of[ord(pair[1])]] = False
        if not self.model.byte_fallback:  # characters that are no pieces fuse to one unknown
            lone = [0, *{int(class_of[ord(c)]) for c in set().union(*beside) if c not in ids}]
            apart[lone, :] = apart[:, lone] = False
        return class_of, apart

    def _arises(self, piece: str, i: int) -> bool:
        """Can a piece arise by merging?  Shorter pieces have been asked for."""
        if len(piece) < 2:
            self.orderly.add(i)
            return True
        parts = merge(self.model, piece, 2)
        if len(parts) > 2:
            return False
        a, b = map(self.model.ids.get, parts)
        scores = self.model.scores
        if a in self.orderly and b in self.orderly and all(self.size[x] == 1 or scores[x] > scores[i] for x in (a, b)):
            self.split[i] = a, b
            self.orderly.add(i)
        return True

    def _fits(self, a: int, b: int) -> bool:
        """May piece b follow piece a?"""
        key = a * len(self.size) + b
        fits = self.pairs.get(key)
        if fits is None:
            if a in self.orderly and b in self.orderly:
                fits = self._beside(a, b)
            else:
                pa_, pb = self.model.pieces[a], self.model.pieces[b]
                fits = merge(self.model, pa_ + pb) == [pa_, pb]
            if len(self.pairs) > 2 * KEPT:
                self.pairs.clear()
            self.pairs[key] = fits
        return fits

    def _beside(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b, by undoing their merges from the last one on.

        Merges of a and b come by falling score, left ones first.  The pieces that stand side by side before
        a merge is undone would have been joined if that scored better than the merge undone, or as well and further left.
        """
        pieces, scores, ids, split = self.model.pieces, self.model.scores, self.model.ids, self.split
        least, tie = -math.inf, False
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and (scores[joined] > least or tie and scores[joined] == least):
                return False
            of_a = scores[a] if a in split else math.inf
            of_b = scores[b] if b in split else math.inf
            if of_a == of_b == math.inf:
                return True
            if of_a < of_b:
                least, tie, a = of_a, False, split[a][1]
            else:
                least, tie, b = of_b, True, split[b][0]

    def _lone(self, char: str) -> tuple[int, ...]:
        """The ids of a character that is no piece."""
        if self.model.byte_fallback:
            return tuple(self.model.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
        return (self.model.unknown,)

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each word.  The words are sorted, so that each prefix's state is computed once."""
        bpe, scores, size, n_pieces = self.model.kind == BPE, self.model.scores, self.size, len(self.size)
        next_, fail, ends, pairs, alone = self.next, self.fail, self.ends, self.pairs.get, self.model.unknown_score
        out: dict[str, tuple[int, ...]] = {}
        # by length of prefix: last piece (-1: a character that is no piece, or the start), node, and for unigram models the score
        last, nodes, total = [-1], [0], [0.0]
        before = ""
        for word in sorted(words):
            i = 0
            for c, d in zip(before, word):
                if c != d:
                    break
                i += 1
            del last[i + 1 :], nodes[i + 1 :], total[i + 1 :]
            node = nodes[i]
            for c in word[i:] if i else word:
                to = next_[node].get(c)
                while to is None and node:
                    node = fail[node]
                    to = next_[node].get(c)
                node = to or 0
                i += 1
                choice = -1
                if bpe:
                    for piece in ends[node]:
                        prev = last[i - size[piece]]
                        if prev >= 0:
                            ok = pairs(prev * n_pieces + piece)
                            if ok is None:
                                ok = self._fits(prev, piece)
                            if not ok:
                                continue
                        choice = piece
                        break
                else:
                    best, single = 0.0, False
                    for piece in ends[node]:
                        score = total[i - size[piece]] + scores[piece]
                        single = size[piece] == 1
                        if choice < 0 or score > best:
                            choice, best = piece, score
                    if choice < 0 or not single and total[i - 1] + alone > best:
                        choice, best = -1, total[i - 1] + alone
                    total.append(best)
                last.append(choice)
                nodes.append(node)
            ids: list[int] = []
            at = len(word)
            while at:
                piece = last[at]
                if piece >= 0:
                    ids.append(piece)
                    at -= size[piece]
                else:
                    at -= 1
                    # characters that are no pieces fuse to one unknown
                    if self.model.byte_fallback or not (ids and ids[-1] == self.model.unknown):
                        ids.extend(reversed(self._lone(word[at])))
            ids.reverse()
            out[word] = tuple(ids)
            before = word
        return out

    def words_of(self, text: str) -> list[str]:
        """The marked text, cut wherever no piece holds the two characters side by side."""
        if not text:
            return []
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        classes = self.class_of[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(self.apart[classes[:-1], classes[1:]]) + 1).tolist()
        return [marked[i:j] for i, j in zip([0, *cuts], [*cuts, len(marked)])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text: the batch's new words are encoded together, and a text's ids are its words' joined."""
        split = [self.words_of(t) for t in texts]
        known = self.known
        fresh = set().union(*split).difference(known)
        known.update((w, array("i", ids).tobytes()) for w, ids in self.encode_words(fresh).items())
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]
        # frequent words are short and come early: once full, what is kept stays
        room = KEPT + len(fresh) - len(known)
        for w in fresh:
            if room > 0 and len(w) <= LONG:
                room -= 1
            else:
                del known[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: invalid bytes become U+FFFD, the added first space goes."""
        text = b"".join(map(self.model.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def forget(self) -> None:
        """Drop what was kept between batches."""
        self.known.clear()
        self.pairs.clear()


#: One encoder in a worker process; a task finds what an earlier one left.
_ENCODERS: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Model(data))
    return _ENCODERS[key]


def read_model(spark: SparkSession, path: str = DEFAULT_MODEL) -> bytes:
    """The bytes of a model file: a local path of the driver, or any path with a scheme that Spark reads."""
    if "://" in path:
        row = spark.read.format("binaryFile").load(path).select("length", "content").first()
        data = bytes(row["content"])
    else:
        with open(path, "rb") as f:
            data = f.read(MAX_MODEL + 1)
    if len(data) > MAX_MODEL:
        raise ValueError("the model is larger than may be broadcast")
    return data


def encode(docs: DataFrame, model: bytes, columns: list[str], text_col: str = "text", check: bool = True) -> DataFrame:
    """The named columns, ids (array of int) and, with check, round_trip: whether decoding the ids gives the text back.

    A null or empty text has no ids.  One pass over the rows, without a shuffle:
    the distinct words of every megabyte of text that aren't known yet are encoded
    together.  Texts are
    encoded whole, however long.  Every row gives a row: repeated rows have equal
    ids.  Named columns that are called ids or round_trip are replaced.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    results = ["ids", *(["round_trip"] if check else [])]
    columns = [c for c in columns if c not in results]
    n = len(columns)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text_col).cast("string").alias("text"))
    names = [*columns, *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        try:
            for batch in small_batches(batches):
                texts = [t or "" for t in batch.column(n).to_pylist()]
                ids = own.encode_batch(texts)
                ends = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
                cols = [*batch.columns[:n], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))]
                if check:
                    cols.append(pa.array([own.decode(x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            own.forget()
            hand_back()

    fields = [T.StructField(c, docs.schema[c].dataType) for c in columns] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields + ([T.StructField("round_trip", T.BooleanType())] if check else [])))


def decode(tokens: DataFrame, model: bytes, columns: list[str], ids_col: str = "ids") -> DataFrame:
    """The named columns and text, decoded from ids.  Null ids give a null text; ids outside the vocabulary raise."""
    spark = tokens.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*columns, "text"])

    return tokens.select(*columns, ids_col).mapInArrow(run, T.StructType([*(tokens.schema[c] for c in columns), T.StructField("text", T.StringType())]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, read_model(spark), ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
