"""SentencePiece encoding and decoding by a forward pass that shares prefixes.

A text is marked (spaces become U+2581, one is put in front) and cut into marked words;
no piece of the model reaches past a word's end, so words are encoded on their own.  The
distinct words of a batch are sorted, which lays them out as a trie in depth-first order:
the forward values of the prefix that a word shares with the one before are kept, and only
the rest is computed.  A backward walk over the stored last pieces gives the ids.

The forward value at a position depends on the model's kind:

* unigram: the best sum of scores (Viterbi), with the last piece that reaches it;
* BPE: scores are merge ranks, so a best sum is not the model's encoding.  There the value
  is the last piece of the prefix's own encoding: the one piece ending here that stands
  beside the last piece of what is left without being merged otherwise.  Two pieces can
  stand side by side if merging their joined text by rank gives just the two; a sequence is
  the model's encoding exactly if all its neighbours can, so this value also depends on the
  prefix only and is shared in the same way.

Characters outside the vocabulary become byte pieces, or the unknown id without byte
fallback.  Nothing is shuffled; the model goes to the executors as a broadcast of its file.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.llm.common import free_name, prepare

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Entries kept between batches: encoded words, and judged pairs of pieces.
CACHE_WORDS = 150_000
CACHE_PAIRS = 400_000
#: Characters of text split into words at once.
SLAB_CHARS = 1 << 20
UNKNOWN_PENALTY = 10.0
#: (no piece, one character): a character outside the vocabulary.
_OUTSIDE = (-1, 1)


def default_model() -> str:
    """The public piece model that comes with the environment."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Vocabulary of a SentencePiece model file (BPE or unigram, identity normalisation)."""

    def __init__(self, body: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(body)
        kinds = {1: "unigram", 2: "bpe"}
        if proto.trainer_spec.model_type not in kinds:
            raise ValueError("only BPE and unigram models are supported")
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.kind, self.prefix = kinds[proto.trainer_spec.model_type], spec.add_dummy_prefix
        self.id, self.score, self.byte, self.spelled = {}, {}, {}, []
        self.scores = [p.score for p in proto.pieces]
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            body = b""
            if p.type == 1 or p.type == 4:  # normal, user defined
                self.id[p.piece], self.score[p.piece] = i, p.score
                body = p.piece.encode()
            elif p.type == 6:
                value = int(p.piece[3:-1], 16)
                self.byte[value] = i
                body = bytes([value])
            elif p.type == 2:
                self.unknown, body = i, " ⁇ ".encode()
            self.spelled.append(body)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece reaches past a word's end")
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.words: dict[str, int] = {}  # of a key: its place in at, which bounds its ids in pool
        self.pool, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        # line ends stand alone if no piece holds them
        self.lines = self.prefix and bool(self.byte) and not any("\n" in p for p in self.id)
        self.pairs: dict[int, bool] = {}
        self._suffixes()

    def _suffixes(self) -> None:
        """Automaton that knows, after each character, the pieces that end there (longest first)."""
        self.text = {i: p for p, i in self.id.items()}
        children: list[dict[str, int]] = [{}]
        ends: list[tuple] = [()]
        for piece, i in self.id.items():
            node = 0
            for c in piece:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    ends.append(())
            ends[node] = ((i, len(piece)),)
        fail, queue = [0] * len(children), list(children[0].values())
        for node in queue:
            for c, down in children[node].items():
                up = fail[node]
                while up and c not in children[up]:
                    up = fail[up]
                fail[down] = children[up].get(c, 0)
                ends[down] += ends[fail[down]]
                queue.append(down)
        self.steps, self.fail, self.ends = children, fail, ends

    def merged(self, text: str) -> list[str]:
        """Merging by rank: the adjacent pair with the best score first, the leftmost of equals."""
        parts, get, none = list(text), self.score.get, float("-inf")
        rank = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank and (best := max(rank)) > none:
            i = rank.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def beside(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined text is just these two pieces (left: -1 for none)."""
        a, b = self.text.get(left, ""), self.text[right]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        got = self.pairs[left * len(self.spelled) + right] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def _bpe(self, word, start, node, last, value) -> None:
        steps, ends, pairs, many = self.steps, self.ends, self.pairs, len(self.spelled)
        at = node[start]
        for i in range(start + 1, len(word) + 1):
            c = word[i - 1]
            to = steps[at].get(c)
            node[i] = at = self._step(at, c) if to is None else to
            last[i] = _OUTSIDE
            for end in ends[at]:
                left = last[i - end[1]][0]
                ok = pairs.get(left * many + end[0])
                if ok or ok is None and self.beside(left, end[0]):
                    last[i] = end
                    break

    def _step(self, at: int, c: str) -> int:
        """Node after ``c``, by the failure links; remembered for characters of the vocabulary."""
        to = at
        while to and c not in self.steps[to]:
            to = self.fail[to]
        to = self.steps[to].get(c, 0)
        if to:
            self.steps[at][c] = to
        return to

    def _unigram(self, word, start, node, last, value) -> None:
        ends, steps = self.ends, self.steps
        at = node[start]
        for i in range(start + 1, len(word) + 1):
            to = steps[at].get(word[i - 1])
            node[i] = at = self._step(at, word[i - 1]) if to is None else to
            choice, top = None, 0.0
            for end in ends[at]:  # of equal sums the longest last piece
                sum_ = value[i - end[1]] + self.scores[end[0]]
                if choice is None or sum_ > top:
                    choice, top = end, sum_
            if not ends[at] or ends[at][-1][1] > 1:
                sum_ = value[i - 1] + self.least
                if choice is None or sum_ > top:
                    choice, top = _OUTSIDE, sum_
            last[i], value[i] = choice, top

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of each distinct word: depth-first over the sorted words, prefixes' values reused."""
        step = self._bpe if self.kind == "bpe" else self._unigram
        out: dict[str, list[int]] = {}
        before = ""
        room = 1 + max(map(len, words), default=0)
        node, last, value = [0] * room, [(-1, 0)] * room, [0.0] * room
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            step(word, shared, node, last, value)
            ids, i, was_unknown = [], len(word), False
            while i:
                piece, n = last[i]
                i -= n
                if piece >= 0:
                    ids.append(piece)
                elif self.byte:
                    ids += [self.byte[b] for b in reversed(word[i].encode())]
                elif not was_unknown:
                    ids.append(self.unknown)
                was_unknown = piece < 0
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def _keys(self, text: str) -> list[str]:
        """Names of a text's marked words in order: the word less its mark; ``\\n`` for a line end,
        ``\\0`` before a word without a mark, ``\\1`` before a word as it stands."""
        if self.lines and not ("\x00" in text or "\x01" in text or MARK in text):
            spaced = text.replace("\n", " \n \x00")
            if "  " not in spaced and spaced[0] != " " and spaced[-1] != " ":
                return spaced.split(" ")
        return ["\x01" + w for w in _WORD.findall((MARK if self.prefix else "") + text.replace(" ", MARK))]

    def _marked(self, key: str) -> str:
        return key if key == "\n" else key[1:] if key[:1] in ("\x00", "\x01") else MARK + key

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one longer than the texts)."""
        ids, bounds, start, held = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held > SLAB_CHARS or i + 1 == len(texts):
                some, own = self._encode(texts[start:i + 1])
                ids.append(some)
                bounds.append(own[1:] + bounds[-1][-1])
                start, held = i + 1, 0
        return np.concatenate(ids), np.concatenate(bounds)

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        keys = [self._keys(t) if t else [] for t in texts]
        bounds = np.cumsum([0] + [len(k) for k in keys])
        flat = list(chain.from_iterable(keys))
        del keys
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.pool, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        new = list(set(flat).difference(self.words))
        if new:
            coded = self.encode_words({self._marked(k) for k in new})
            ids = [coded[self._marked(k)] for k in new]
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(i) for i in ids])])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32)])
        word = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        del flat
        ids, ends = _gather(self.pool, self.at, word)
        return ids, np.append(0, ends)[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids laid out as ``encode`` does; ids that aren't in the model are passed over."""
        n = len(self.spelled)
        pool = np.frombuffer(b"".join(self.spelled), np.uint8)
        at = np.append(0, np.cumsum([len(x) for x in self.spelled] + [0]))
        out, start = [], 0
        for i in range(1, len(bounds)):
            if bounds[i] - bounds[start] > SLAB_CHARS or i + 1 == len(bounds):
                own = ids[bounds[start]:bounds[i]]
                body, ends = _gather(pool, at, np.where((own >= 0) & (own < n), own, n))
                raw, cut = body.tobytes(), np.append(0, ends)[bounds[start:i + 1] - bounds[start]].tolist()
                for a, b in zip(cut, cut[1:]):
                    text = raw[a:b].decode("utf-8", "replace").replace(MARK, " ")
                    out.append(text[1:] if self.prefix and text[:1] == " " else text)
                start = i
        return out


def _gather(pool: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pool[at[w]:at[w + 1]]`` of all ``which`` in a row, and their ends."""
    size = at[which + 1] - at[which]
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return pool[:0], ends
    return pool[np.repeat(at[which] - ends + size, size) + np.arange(ends[-1])], ends


_LOADED: dict = {}


def _model(shared) -> PieceModel:
    name, body = shared.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = PieceModel(body)
    return _LOADED[name]


def _shared(spark: SparkSession, model: str | None):
    prepare(spark)
    with open(model or default_model(), "rb") as f:
        body = f.read()
    PieceModel(body)  # fails here, not in a task, on an unsupported model
    return spark.sparkContext.broadcast((uuid.uuid4().hex, body))


def piece_encode(docs: DataFrame, model: str | None = None, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``docs`` with one more column ``tokens`` (array of int; ``_`` is added while the name is taken).

    ``model`` is a path on the driver.  Null texts give null, empty texts no ids.  Repeated rows
    and ties are encoded alike, and all other columns pass through.
    """
    shared = _shared(docs.sparkSession, model)
    out = free_name(docs, tokens)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        m = _model(shared)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            ids, bounds = m.encode(texts)
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def piece_decode(rows: DataFrame, model: str | None = None, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """``rows`` with ``tokens`` replaced by the text they stand for, in a column ``text`` at the end.

    Null ids give null.  Encoding then decoding returns the text itself, but for U+2581, which
    the format can't tell from a space.
    """
    shared = _shared(rows.sparkSession, model)
    rest = [f for f in rows.schema.fields if f.name != tokens]
    out = text
    while out.lower() in {f.name.lower() for f in rest}:
        out += "_"

    def run(batches):
        m = _model(shared)
        for b in batches:
            i = b.schema.get_field_index(tokens)
            column = b.column(i)
            size = np.append(0, pc.fill_null(pc.list_value_length(column), 0).to_numpy()).cumsum()
            ids = pc.fill_null(pc.list_flatten(column), -1).to_numpy(zero_copy_only=False)
            got = pa.array(m.decode(ids, size), pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[c for j, c in enumerate(b.columns) if j != i], got],
                                             [*[f.name for f in rest], out])

    return rows.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: doc_id, n_tokens, tokens_sha256 (ids joined by
    commas), decoded_sha256, round_trip (decoded = text, U+2581 read as a space)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = piece_encode(docs).select(
        "doc_id", F.translate("text", MARK, " ").alias("text"), "tokens",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",").cast("binary"), 256)
        .alias("tokens_sha256"))
    return piece_decode(coded).select(
        "doc_id", "n_tokens", "tokens_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"))
