"""Chat formatting by token-level assembly.

Every text is escaped and encoded on its own, the template's marks are
spliced in as reserved ids that lie beyond the vocabulary, and the loss mask
is the running difference of opening and closing marks.  Text can therefore
never turn into a mark, neither as ids nor in the written form.

Template (``MARKS``, in written form):

    <s>                                   before a conversation
    [SYS]text[/SYS]                       system
    [INST]text[/INST]                     user
    [ASST]text</s>                        assistant; its text is under the loss
    [ROLE]role[/ROLE]text[/TURN]          any other role

Escaping puts a backslash after the first character of every mark that
occurs in a text (``</s>`` becomes ``<\\/s>``), and one more where backslashes
already stand there, so it is undone exactly.

A conversation comes out as parts in order, cut between turns once a part has
``PART_IDS`` ids; an ordinary one is a single part.  A conversation of any
number of turns is sorted and streamed, and never gathered into one row.

Defined results for odd input: a null text is empty; a null role is the role
""; turns are ordered by turn (null first), then role and text; repeated
rows are turns of their own; a null ``conv_id`` is a conversation; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pretok import worker_pieces
from tessera.llm.textvec import slices, text_bytes
from tessera.llm.worker import held

MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ASST]", "[ROLE]", "[/ROLE]", "[/TURN]")
_FRAMES = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[ASST]", "</s>")}
_ROLE_OF = {opening: role for role, (opening, _) in _FRAMES.items()}

#: A part of so many ids is closed at the next turn.
PART_IDS = 1 << 18

_MARKED = re.compile("|".join(rf"{re.escape(m[0])}(\\*){re.escape(m[1:])}" for m in MARKS))
_ESCAPED = re.compile("|".join(rf"{re.escape(m[0])}\\(\\*){re.escape(m[1:])}" for m in MARKS))


def escape(text: str) -> str:
    """``text`` without any mark in it."""
    return _MARKED.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


def reserved_ids(vocabulary: int) -> dict[str, int]:
    """An id beyond the vocabulary for every mark."""
    return {m: vocabulary + k for k, m in enumerate(MARKS)}


def _place(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> None:
    """Write run k of ``values`` (between its offsets) to ``out`` from ``at[k]`` on."""
    out[np.repeat(at - offsets[:-1], np.diff(offsets)) + np.arange(len(values))] = values


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _turn_encoder(tokenizer_file: str):
    """Ids of each turn with its marks; the role and the text are encoded separately."""

    def encode(batches):
        pieces = worker_pieces(tokenizer_file)
        ids_of = reserved_ids(pieces.tokenizer.get_vocab_size())
        for batch in batches:
            for rows, _, _ in slices(batch):
                roles = rows.column(2).to_pylist()
                other = np.array([r not in _FRAMES for r in roles])
                frames = [_FRAMES.get(r, ("[ROLE]", "[/TURN]")) for r in roles]
                text, t_off = pieces.encode(*text_bytes(pa.array([escape(t) for t in rows.column(3).to_pylist()])), special=False)
                role, r_off = pieces.encode(*text_bytes(pa.array([escape(r) if o else "" for r, o in zip(roles, other, strict=True)])), special=False)
                inner = np.diff(r_off) + other  # the role and the mark behind it
                offsets = np.concatenate([[0], np.cumsum(inner + np.diff(t_off) + 2)])
                first = offsets[:-1]
                ids = np.empty(offsets[-1], np.int32)
                ids[first] = [ids_of[opening] for opening, _ in frames]
                _place(ids, first + 1, r_off, role)
                ids[(first + inner)[other]] = ids_of["[/ROLE]"]
                _place(ids, first + 1 + inner, t_off, text)
                ids[offsets[1:] - 1] = [ids_of[closing] for _, closing in frames]
                yield pa.record_batch([*rows.columns, _lists(ids, offsets)], names=["conv_id", "turn", "role", "text", "ids"])

    return encode


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The lists of a column as arrays."""
    lists = batch.column(column)
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _assembler(tokenizer_file: str):
    """Join the turns of each conversation, which come in order, and derive the mask by prefix sums."""

    def joined(rows: list[list], ids_of: dict[str, int]) -> pa.RecordBatch:
        ids = np.concatenate([piece for row in rows for piece in row[2]])
        opened, closed = np.cumsum(ids == ids_of["[ASST]"]), np.cumsum(ids == ids_of["</s>"])
        mask = (opened > closed) & (ids != ids_of["[ASST]"])
        offsets = np.cumsum([0] + [row[3] for row in rows])
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), _lists(ids, offsets), _lists(mask, offsets)], names=["conv_id", "part", "ids", "loss_mask"])

    def assemble(batches):
        ids_of = reserved_ids(worker_pieces(tokenizer_file).tokenizer.get_vocab_size())
        rows, ready = [], 0  # rows [conv_id, part, pieces, size], of which the last one is still open
        for batch in batches:
            for conv, ids in zip(batch.column(0).to_pylist(), _rows(batch, 1), strict=True):
                if not rows or rows[-1][0] != conv:
                    rows.append([conv, 0, [np.array([ids_of["<s>"]], np.int32)], 1])
                elif rows[-1][3] >= PART_IDS:
                    rows.append([conv, rows[-1][1] + 1, [], 0])
                rows[-1][2].append(ids)
                rows[-1][3] += len(ids)
                ready += len(ids)
                if ready >= 2 * PART_IDS and len(rows) > 1:
                    yield joined(rows[:-1], ids_of)
                    rows, ready = rows[-1:], rows[-1][3]
        if rows:
            yield joined(rows, ids_of)

    return assemble


def formatted_chats(conversations: DataFrame, tokenizer_file: str) -> DataFrame:
    """conv_id, part, ids, loss_mask: the parts of each conversation, in order.

    Turns are encoded where they are read and then sorted by conversation, so
    that a task holds one part at a time, however many turns share a ``conv_id``.
    All parts of a conversation follow each other in one partition.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    turns = rows.mapInArrow(_turn_encoder(tokenizer_file), "conv_id bigint, turn bigint, role string, text string, ids array<int>")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids").mapInArrow(_assembler(tokenizer_file), "conv_id bigint, part int, ids array<int>, loss_mask array<boolean>")


class ChatReader:
    """Reads assembled ids back: written form, turns, and text under the loss."""

    def __init__(self, tokenizer_file: str):
        from tessera.llm.pretok import byte_letters

        tokenizer = worker_pieces(tokenizer_file).tokenizer
        self.vocabulary = tokenizer.get_vocab_size()
        value = {c: b for b, c in enumerate(byte_letters())}
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        tokens = (tokenizer.id_to_token(i) for i in range(self.vocabulary))
        spelled = [t.encode() if t in special else bytes(value[c] for c in t) for t in tokens] + [b""] * len(MARKS)
        self.size = np.array([len(b) for b in spelled])
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def _bytes(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids (marks have none), and where those of each id begin."""
        size = self.size[ids]
        offsets = np.concatenate([[0], np.cumsum(size)])
        return self.letters[np.repeat(self.start[ids] - offsets[:-1], size) + np.arange(offsets[-1])].tobytes(), offsets

    def text(self, ids: Iterable[int]) -> str:
        return self._bytes(np.asarray(ids, np.int64))[0].decode()

    def segments(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str]]:
        """(mark, text before it, the part of that text under the loss) of each mark."""
        raw, offsets = self._bytes(ids)
        marks = np.flatnonzero(ids >= self.vocabulary)
        begin = np.concatenate([[0], marks[:-1] + 1])
        masked = np.concatenate([[0], np.cumsum(mask)])
        covered = masked[marks] - masked[begin]
        for mark, a, b, first, last, n in zip((ids[marks] - self.vocabulary).tolist(), begin.tolist(), marks.tolist(), offsets[begin].tolist(), offsets[marks].tolist(), covered.tolist(), strict=True):
            content = raw[first:last].decode()
            under = content if n == b - a else self.text(ids[a:b][mask[a:b]]) if n else ""
            yield MARKS[mark], content, under

    def read(self, ids: Iterable[int], mask: Iterable[bool]) -> tuple[str, list[tuple[str, str]], str]:
        """(written form, [(role, text)], text under the loss) of a part."""
        written, turns, loss = [], [], []
        role = ""
        for mark, content, under in self.segments(np.asarray(ids, np.int64), np.asarray(mask, bool)):
            written += [content, mark]
            if mark == "[/ROLE]":
                role = unescape(content)
            elif mark in _ROLE_OF:
                role = _ROLE_OF[mark]
            elif mark not in ("<s>", "[ROLE]"):
                turns.append((role, unescape(content)))
                loss.append(unescape(under))
        return "".join(written), turns, "".join(loss)


class _Digest:
    """What is reported of a conversation, part by part."""

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.loss_chars, self.formatted_chars, self.n_tokens = conv, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, reader: ChatReader, ids: np.ndarray, mask: np.ndarray) -> None:
        written, turns, loss = reader.read(ids, mask)
        self.turns.update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
        self.loss.update(loss.encode())
        self.n_turns += len(turns)
        self.loss_chars += len(loss)
        self.formatted_chars += len(written)
        self.n_tokens += len(ids)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_tokens


DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"


def _digester(tokenizer_file: str):
    def batch_of(done: list[_Digest]) -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*(d.row() for d in done), strict=True), kinds, strict=True)], names=names)

    def digest(batches):
        reader = held("tokens", "reader", tokenizer_file, lambda: ChatReader(tokenizer_file))
        done = []  # the last one is still open
        for batch in batches:
            for conv, ids, mask in zip(batch.column(0).to_pylist(), _rows(batch, 2), _rows(batch, 3), strict=True):
                if not done or done[-1].conv != conv:
                    done.append(_Digest(conv))
                done[-1].add(reader, ids, mask)
            if len(done) > 1:
                yield batch_of(done[:-1])
                done = done[-1:]
        if done:
            yield batch_of(done)

    return digest


def chat_digest(chats: DataFrame, tokenizer_file: str) -> DataFrame:
    """What can be read back from formatted conversations.

    ``chats`` are as ``formatted_chats`` leaves them: parts of a conversation
    follow each other in one partition.  Stored ones are to be repartitioned by
    ``conv_id`` and sorted by ``conv_id, part`` in their partitions first.
    """
    return chats.mapInArrow(_digester(tokenizer_file), DIGEST_SCHEMA)
