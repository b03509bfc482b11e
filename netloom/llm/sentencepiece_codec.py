"""SentencePiece encoding by Viterbi over a shared-prefix trie, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, text_blocks

SPACE = "▁"
#: Bytes of words and their ids that a Python worker keeps from block to block and task to
#: task, about, and characters of a word that is kept.
CACHE_BYTES, KEPT_LENGTH = 64 << 20, 64
#: What an entry takes beside its characters and ids.
_ENTRY = 200
#: Words whose trie is walked at a time.
WORDS = 1 << 14


class Known(dict):
    """Words and their ids; ``size`` is about what they take."""

    size = 0

    def settle(self, new: dict[str, bytes]) -> None:
        """After a block with these new words: long ones go, and all do once there is too much."""
        for word, ids in new.items():
            if len(word) > KEPT_LENGTH:
                del self[word]
            else:
                self.size += _ENTRY + len(word) + len(ids)
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0


_KNOWN: dict[str, Known] = {}
# Kinds of pieces in a SentencePiece model file.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


class Model:
    """Pieces and scores of a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without normalisation are supported")
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.pieces: dict[str, tuple[float, int]] = {}
        self.unknown, self.bytes_, self.surface = 0, [-1] * 256, []
        for i, p in enumerate(proto.pieces):
            if p.type in (NORMAL, USER_DEFINED):
                self.pieces[p.piece] = (p.score, i)
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == BYTE:
                self.bytes_[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.unknown = i if p.type == 2 else self.unknown
                self.surface.append(b"")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece spans two words; words cannot be encoded alone")
        self.endings = {p[i:] for p in self.pieces for i in range(len(p))}
        self.worst = min((s for s, _ in self.pieces.values()), default=0.0) - 10

    def fallback(self, char: str) -> list[int]:
        ids = [self.bytes_[b] for b in char.encode()]
        return [self.unknown] if -1 in ids else ids


@cache
def load_model(path: str) -> Model:
    """The model, read once in each Python worker."""
    return Model(path)


def encode_words(words: Iterable[str], model: Model) -> dict[str, list[int]]:
    """The best segmentation of each distinct marked word.

    Sorted words are the depth-first order of their trie: what a word shares with
    the one before is a path already walked, whose forward scores stand. ``best[p]``
    is the best score of the first p characters and ``start[p]`` where its last
    piece begins; both depend on those characters alone. Pieces that end at p are tried
    from the shortest, as long as some piece ends alike. The longest wins a tie, and a
    character that is no piece becomes bytes."""
    pieces, endings, worst = model.pieces, model.endings, model.worst
    best, start, before = [0.0], [0], ""
    out = {}
    for word in sorted(set(words)):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], start[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, at = None, end - 1
            for s in range(end - 1, -1, -1):
                part = word[s:end]
                if part not in endings:
                    break
                found = pieces.get(part)
                if found is not None and (top is None or best[s] + found[0] >= top):
                    top, at = best[s] + found[0], s
            if word[end - 1] not in pieces and (top is None or best[end - 1] + worst > top):
                top, at = best[end - 1] + worst, end - 1
            best.append(top)
            start.append(at)
        ids, end = [], len(word)
        while end:
            s = start[end]
            found = pieces.get(word[s:end])
            ids.append([found[1]] if found is not None else model.fallback(word[s:end]))
            end = s
        out[word] = [i for part in reversed(ids) for i in part]
        before = word
    return out


class Backward:
    """The trie of all pieces read backward, as arrays: children by node and character, and each
    node's score (NaN where no piece ends) and id. Node 0 is the root, and what is no child."""

    def __init__(self, model: Model) -> None:
        letters = sorted({c for p in model.pieces for c in p})
        #: Each character's number; 0 is in no piece.
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width, self.worst, self.fallback = len(letters) + 1, model.worst, model.fallback
        place = {c: i for i, c in enumerate(letters, 1)}
        nodes, keys = {"": 0}, []
        for piece in model.pieces:
            for i in range(len(piece) - 1, -1, -1):
                if piece[i:] not in nodes:
                    nodes[piece[i:]] = len(nodes)
                    keys.append(nodes[piece[i + 1 :]] * self.width + place[piece[i]])
        self.keys = pd.Index(np.array(keys, np.int64))
        at = [nodes[p] for p in model.pieces]
        self.score, self.id = np.full(len(nodes), np.nan), np.zeros(len(nodes), np.int64)
        self.score[at], self.id[at] = zip(*model.pieces.values(), strict=True)
        self.alone = np.zeros(self.width, bool)
        self.alone[[place[p] for p in model.pieces if len(p) == 1]] = True

    def child(self, nodes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return self.keys.get_indexer(nodes * self.width + numbers) + 1


@cache
def backward(model: Model) -> Backward:
    """The model's trie, made once in each Python worker."""
    return Backward(model)


def encode_short(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What ``encode_words`` gives for these sorted, distinct words, as one array of ids and
    the words' bounds in it. Their trie is walked by depth, all its nodes of one depth at once:
    a node is the first word with its characters, and the words that share them take over
    its score, size and piece. Arrays hold as many columns as the longest word has characters."""
    trie, n = backward(model), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    most = int(lengths.max(initial=1))
    codes = np.ascontiguousarray(np.array(words, f"U{most}").view(np.uint32).reshape(n, most).T)
    numbers = trie.number[codes]
    alike = np.logical_and.accumulate(codes[:, 1:] == codes[:, :-1]).sum(axis=0)
    shared = np.concatenate([[0], np.minimum(alike, np.minimum(lengths[1:], lengths[:-1]))])
    best, size, piece = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int32), np.zeros((most + 1, n), np.int64)
    for end in range(1, most + 1):
        rows = np.flatnonzero((shared < end) & (lengths >= end))
        if not len(rows):
            continue
        # A character that is no piece has a negative id until it becomes bytes.
        top = np.where(trie.alone[numbers[end - 1, rows]], -np.inf, best[end - 1, rows] + trie.worst)
        cut, chosen = np.ones(len(rows), np.int32), -1 - codes[end - 1, rows].astype(np.int64)
        live, nodes = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for start in range(end - 1, -1, -1):
            nodes = trie.child(nodes, numbers[start, rows[live]])
            live, nodes = live[nodes > 0], nodes[nodes > 0]
            if not len(live):
                break
            total = best[start, rows[live]] + trie.score[nodes]
            better = total >= top[live]  # never true of NaN
            to = live[better]
            top[to], cut[to], chosen[to] = total[better], end - start, trie.id[nodes[better]]
        first = np.maximum.accumulate(np.where(shared < end, np.arange(n), 0))
        for array, values in ((best, top), (size, cut), (piece, chosen)):
            array[end, rows] = values
            array[end] = array[end, first]
    ids, used = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    live, ends = np.flatnonzero(lengths), lengths[lengths > 0]
    for column in range(most - 1, -1, -1):
        ids[live, column], used[live, column] = piece[ends, live], True
        ends = ends - size[ends, live]
        live, ends = live[ends > 0], ends[ends > 0]
    flat, bounds = ids[used], np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    other = flat < 0
    if other.any():
        spelled = [trie.fallback(chr(-1 - i)) for i in flat[other].tolist()]
        counts = np.ones(len(flat), np.int64)
        counts[other] = [len(x) for x in spelled]
        flat, other = np.repeat(flat, counts), np.repeat(other, counts)
        flat[other] = np.concatenate(spelled)
        bounds = np.concatenate([[0], np.cumsum(counts)])[bounds]
    return flat.astype(np.int32), bounds


def encode_new(words: Iterable[str], model: Model) -> dict[str, bytes]:
    """Each word's ids as 32-bit numbers. Words too long to keep are walked one character
    after another, the others together."""
    words = sorted(words)
    long = encode_words([w for w in words if len(w) > KEPT_LENGTH], model)
    found = {w: np.array(ids, np.int32).tobytes() for w, ids in long.items()}
    short = [w for w in words if len(w) <= KEPT_LENGTH]
    for i in range(0, len(short), WORDS):
        part = short[i : i + WORDS]
        flat, bounds = encode_short(part, model)
        raw, at = flat.tobytes(), (4 * bounds).tolist()
        found.update((w, raw[x:y]) for w, x, y in zip(part, at, at[1:], strict=False))
    return found


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` (null became empty) and ``ids``: the pieces whose scores have the
    largest sum, found word by word (a word is marked by the spaces before it).

    A task collects the distinct words of each block that it has not met yet, sorts
    them and walks their trie; no text is shuffled. A null or empty text has no ids;
    null ids and repeated rows pass through; an empty table gives none; further columns
    are ignored. U+2581 in a text counts as a space, as in the format itself. A text without
    spaces is one word of any length, which is not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load_model(model_path), _KNOWN.setdefault(model_path, Known())
        for batch, *_ in text_blocks(batches):
            rows = [_WORDS.findall(model.prefix + t.replace(" ", SPACE)) if t else [] for t in batch.column(1).to_pylist()]
            new = {w for row in rows for w in row if w not in known}
            found = encode_new(new, model)
            known.update(found)
            flat = [b"".join(map(known.__getitem__, row)) for row in rows]
            known.settle(found)
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(flat), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["doc_id", "text", "ids"])

    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return short_batches(source).mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def joined(surface: pa.Array, ids: pa.ListArray, prefixed: bool) -> pa.Array:
    """The texts of all lists of ids, ``surface`` being each id's bytes; where the model has a
    prefix, a first space goes."""
    values = ids.flatten()
    if values.null_count:
        raise ValueError("an id is null")
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    parts = surface.take(values)
    ends = np.frombuffer(parts.buffers()[1], np.int32)[bounds] if len(values) else np.zeros(len(bounds), np.int32)
    data = np.frombuffer(parts.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    if prefixed:
        rows = np.flatnonzero(ends[1:] > ends[:-1])
        rows = rows[data[ends[rows]] == ord(" ")]
        gone = np.zeros(len(ends), np.int32)
        gone[rows + 1] = 1
        data, ends = np.delete(data, ends[rows]), ends - np.cumsum(gone, dtype=np.int32)
    texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])
    texts = pc.if_else(ids.is_valid(), texts, None)
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the text of ``ids_col``; null ids decode to null. Bytes that
    are no UTF-8 become U+FFFD. Ids out of range raise an error."""
    names = encoded.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        surface = pa.array(model.surface, pa.binary())
        for batch in batches:
            texts = joined(surface, batch.column(at), bool(model.prefix))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "decoded"])

    # Spark looks columns up by name on the way in, where a name may hold a dot.
    plain = encoded.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
