"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A BPE encoding is valid exactly if every two neighbouring tokens are what merging
their joined text gives again. So the longest piece at each position (from an
Aho-Corasick automaton) is tried first, kept if it is compatible with the token
before it, shortened to its next prefix piece otherwise; positions from which no
piece fits are remembered in a bitfield and never entered again.

No piece holds the blank mark after another character, so a text is cut before the
blank marks and at characters outside the vocabulary, and each part is encoded once
per worker while it stays in a bounded cache, for as long as the worker's tasks use the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, text_session

BLANK = "▁"
#: Entries of the caches of a worker. A full cache of parts becomes the older one, in
#: place of the one before; a full cache of pairs is emptied.
CACHED_PARTS = 150_000
CACHED_PAIRS = 400_000
#: Longer parts are encoded each time.
CACHED_LENGTH = 48


def vocabulary(path: str) -> dict:
    """Pieces, scores and kinds of a model file, as plain lists that can be broadcast.

    The file must be a BPE model with the identity normalizer and the usual blank
    in front; anything else is refused. An unknown character becomes bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    probe = "  ﬁ  Å x "
    if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
        raise ValueError("only models with the identity normalizer and a blank in front are supported")
    byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("only models with byte fallback are supported")
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
    return {
        "pieces": [model.id_to_piece(i) for i in range(size)],
        "scores": [model.get_score(i) for i in range(size)],
        "plain": plain,
        "bytes": [byte_ids[b] for b in range(256)],
        "control": [model.is_control(i) for i in range(size)],
        "unknown": model.unk_id(),
        "end": model.eos_id(),
    }


class Coder:
    """Encodes and decodes with one vocabulary. Not shared between threads."""

    def __init__(self, words: dict):
        self.pieces, self.scores, self.end_id = words["pieces"], words["scores"], words["end"]
        self.ids = {p: i for i, (p, plain) in enumerate(zip(self.pieces, words["plain"])) if plain}
        self.byte_ids = words["bytes"]
        self.alphabet = set("".join(self.ids))
        if missing := [c for c in self.alphabet if c not in self.ids]:
            raise ValueError(f"characters of pieces that are no pieces themselves: {missing[:5]}")
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after another character")
        self.barrier = next(c for c in map(chr, range(10, 0x110000)) if c not in self.alphabet)
        self.part = self._parts_pattern()
        self.length = [len(p) for p in self.pieces]
        self.shorter: list[int] = [-1] * len(self.pieces)  # the longest piece that is a proper prefix
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in self.ids:
                    self.shorter[i] = self.ids[piece[:n]]
                    break
        self.automaton.make_automaton()
        self.reach = max(map(len, self.ids))
        self.parts: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the parts before the last emptying
        self.pairs: dict[tuple[int, int], bool] = {}
        self.raw = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        for i, control in enumerate(words["control"]):
            if control:
                self.raw[i] = b""
        self.raw[words["unknown"]] = " ⁇ ".encode()

    def _parts_pattern(self) -> re.Pattern:
        """Cuts a text where no piece can reach across.

        That is before blank marks, around the barrier, and between a letter or digit
        and a sign that follows none of them in any piece.
        """
        letter = re.compile(r"[^\W_]")
        follows: set[str] = set()
        for piece in self.ids:
            follows.update(b for a, b in zip(piece, piece[1:]) if letter.match(a))
        signs = "".join(re.escape(c) for c in sorted(self.alphabet - follows) if not letter.match(c) and c != BLANK)
        bar = re.escape(self.barrier)
        stop = f"[{BLANK}{bar}{signs}]"
        return re.compile(f"{BLANK}*[^\\W_]+(?={stop}|$)|{BLANK}*[^{BLANK}{bar}]+|{BLANK}+|{bar}")

    def remerge(self, text: str) -> list[int]:
        """The encoding of a short text by its merges: best score first, leftmost on ties."""
        symbols = list(text)
        while len(symbols) > 1:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                found = self.ids.get(symbols[i] + symbols[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, where = self.scores[found], i
            if best is None:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return [self.ids[s] for s in symbols]

    def compatible(self, before: int, token: int) -> bool:
        """Whether merging the joined text gives the two tokens again (``before`` -1: none)."""
        known = self.pairs.get((before, token))
        if known is None:
            if before < 0:
                known = self.remerge(self.pieces[token]) == [token]
            else:
                known = self.remerge(self.pieces[before] + self.pieces[token]) == [before, token]
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[before, token] = known
        return known

    def longest(self, run: str, position: int) -> int:
        """The longest piece that begins at a position."""
        rest = run[position : position + self.reach]
        size = self.automaton.longest_prefix(rest)
        while (token := self.ids.get(rest[:size])) is None:
            size -= 1
        return token

    def backtrack(self, run: str, greedy: list[int]) -> tuple[int, ...]:
        """Encode a run of known characters. ``greedy``: the longest pieces one after another."""
        length, shorter, pairs = self.length, self.shorter, self.pairs
        begin: dict[int, int] = {}
        at = 0
        for token in greedy:
            begin[at] = token
            at += length[token]
        size = len(run)
        failed = bytearray((size >> 3) + 1)
        tokens: list[int] = []
        position, token, before = 0, greedy[0], -1
        while position < size:
            end = position + length[token]
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits:
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
            if fits:
                tokens.append(token)
                position, before = end, token
                if position < size:
                    token = begin.get(position, -1)
                    if token < 0:
                        token = begin[position] = self.longest(run, position)
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: step back and shorten the token before
                if not tokens:
                    raise ValueError("no encoding exists")
                failed[position >> 3] |= 1 << (position & 7)
                last = tokens.pop()
                position -= length[last]
                before = tokens[-1] if tokens else -1
                token = shorter[last]
        return tuple(tokens)

    def encode_parts(self, parts: list[str]) -> list[tuple[int, ...]]:
        """Encode several parts with one run of the automaton."""
        runs: list[str] = []
        plan: list[list] = []  # per part: bytes of unknown characters, or numbers of runs
        for part in parts:
            if self.alphabet.issuperset(part):
                plan.append([len(runs)])
                runs.append(part)
                continue
            steps: list = []
            known: list[str] = []
            for c in chain(part, [None]):
                if c is not None and c in self.alphabet:
                    known.append(c)
                    continue
                if known:
                    steps.append(len(runs))
                    runs.append("".join(known))
                    known = []
                if c is not None:
                    steps.append(c.encode("utf-8", "replace"))
            plan.append(steps)
        coded: list[tuple[int, ...]] = []
        matches = self.automaton.iter_long(self.barrier.join(runs))
        at, pairs = -1, self.pairs
        for run in runs:  # the matches of a run end at the last character of it
            at += len(run)
            greedy = []
            before, good = -1, True
            for end, token in matches:
                greedy.append(token)
                if good:
                    good = pairs.get((before, token))
                    if good is None:
                        good = self.compatible(before, token)
                    before = token
                if end == at:
                    break
            coded.append(tuple(greedy) if good else self.backtrack(run, greedy))
            at += 1
        out = []
        for steps in plan:
            if len(steps) == 1 and isinstance(steps[0], int):
                out.append(coded[steps[0]])
            else:
                out.append(tuple(chain.from_iterable(coded[s] if isinstance(s, int) else [self.byte_ids[b] for b in s] for s in steps)))
        return out

    def encode(self, texts: Iterable[str | None], end: bool = True) -> list[list[int]]:
        """The ids of every text (null: empty), with the end id behind if asked for."""
        cut = [self.part.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.parts) >= CACHED_PARTS:
            self.parts, self.older = {}, self.parts
        known, older = self.parts, self.older
        new = set().union(*cut).difference(known)
        again = new.intersection(older)
        known.update((p, older[p]) for p in again)
        fresh = list(new - again)
        for low in range(0, len(fresh), 20_000):
            some = fresh[low : low + 20_000]
            known.update(zip(some, self.encode_parts(some)))
        tail = [self.end_id] if end else []
        out = [list(chain.from_iterable(map(known.__getitem__, parts))) + tail for parts in cut]
        for part in fresh:
            if len(part) > CACHED_LENGTH:
                del known[part]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: control ids vanish, bytes join to characters, the first blank goes."""
        raw = self.raw
        parts = [raw[i] for i in ids]
        first = next((k for k, part in enumerate(parts) if part), None)
        if first is not None and self.pieces[ids[first]][0] == BLANK:
            parts[first] = parts[first][1:]
        return _utf8(b"".join(parts))


def _utf8(raw: bytes) -> str:
    """Decode; every byte that is no part of a character becomes the replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "bytewise")


def _bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _register() -> None:
    import codecs

    codecs.register_error("bytewise", _bytewise)


_register()


class _Vocabulary:
    """A vocabulary and, once a worker asks for it, its coder.

    Spark keeps a broadcast value in a worker as long as tasks use it; coder and caches go with it.
    """

    def __init__(self, words: dict):
        self.words = words
        self.own: Coder | None = None

    def coder(self) -> Coder:
        if self.own is None:
            self.own = Coder(self.words)
        return self.own


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a string array; nulls are empty, broken bytes replaced."""
    return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _shared(spark: SparkSession, path: str):
    """The vocabulary of a model file, broadcast."""
    return spark.sparkContext.broadcast(_Vocabulary(vocabulary(path)))


def encode_column(spark: SparkSession, path: str, text: str):
    """An array<int> column with the ids and the end id of every text."""
    shared = _shared(spark, path)

    def run(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.coder().encode(texts_of(column)), pa.list_(pa.int32()))

    return arrow_column(run, "array<int>")(text)


def decode_column(spark: SparkSession, path: str, ids: str):
    """A text column decoded from an array<int> column; null ids give an empty text."""
    shared = _shared(spark, path)

    def run(column: pa.Array) -> pa.Array:
        coder = shared.value.coder()
        return pa.array([coder.decode(x or []) for x in column.to_pylist()], pa.string())

    return arrow_column(run, "string")(ids)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", out: str = "coded") -> DataFrame:
    """Add a struct column ``out`` (ids, decoded): the ids with the end id, and their text.

    Null and empty texts have the end id only and decode to an empty text. Ids follow
    the merge rules exactly for texts of any length; a literal blank mark U+2581
    decodes to a blank, as the vocabulary cannot tell them apart. Rows are neither
    dropped nor joined, so repeated rows and null ids stay; a column named ``out`` is
    replaced. An empty table stays empty.
    """
    spark = text_session(docs.sparkSession)
    shared = _shared(spark, path)

    def run(column: pa.Array) -> pa.Array:
        coder = shared.value.coder()
        ids = coder.encode(texts_of(column))
        decoded = [coder.decode(x) for x in ids]
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["ids", "decoded"]
        )

    return docs.withColumn(out, arrow_column(run, "struct<ids:array<int>,decoded:string>")(text_col))


def digests(coded: DataFrame, id_col: str = "doc_id", out: str = "coded", ids: str | None = None) -> DataFrame:
    """Counts and SHA-256 digests of a round trip; with ``ids`` also the joined ids under that name."""
    joined = F.array_join(F.col(out).ids.cast("array<string>"), " ")
    return coded.select(
        F.col(id_col),
        F.size(F.col(out).ids).cast("bigint").alias("n_tokens"),
        joined.alias("_joined"),
        F.sha2(F.col(out).decoded.cast("binary"), 256).alias("decoded_sha256"),
    ).select(
        id_col, "n_tokens", F.sha2(F.col("_joined").cast("binary"), 256).alias("ids_sha256"), "decoded_sha256",
        *([F.col("_joined").alias(ids)] if ids else []),
    )
