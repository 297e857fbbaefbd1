"""Chat formatting on the level of tokens.

A turn is START role SEP text END, where the three marks are reserved ids that no text encodes to: role and text are
encoded on their own and the ids are spliced between. Control strings in a text are escaped all the same, so that a
rendering as characters stays unambiguous: each `<` and `|` that only backslashes part get one backslash more.

The output has a row for each turn, with the place of its first token in the conversation, so that no task holds
a conversation as a whole: places come from sums over blocks of turn numbers. The loss mask covers the text of the trained roles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.bpe_words import batches
from lattica.llm.common import ROW, in_arrow, materialize, sized, text_or_empty
from lattica.llm.token_store import tokenizer

#: The reserved ids START, SEP and END are the three after the vocabulary's last; this is what they look like in a rendering.
MARKS = ("<|im_start|>", "\n", "<|im_end|>\n")
#: Turn numbers of a block, the unit in which places are counted.
BLOCK_TURNS = 256


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def byte_chars() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_pieces: dict[str, list[bytes]] = {}


def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file."""
    if path not in _pieces:
        import json

        with open(path) as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_chars().items()}
        vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
        out = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        _pieces[path] = out
    return _pieces[path]


def reserved(path: str) -> tuple[int, int, int]:
    """START, SEP and END for a tokenizer file."""
    n = len(id_bytes(path))
    return n, n + 1, n + 2


def splice(marks: tuple[int, int, int], role_ids: np.ndarray, roles: np.ndarray, text_ids: np.ndarray, texts: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, mask and lengths of turns, from the ids of all roles and of all texts, and the numbers of ids of each.

    The mask is the prefix sum over +1 where a trained text starts and -1 where it ends.
    """
    lengths = roles + texts + 3
    starts = np.cumsum(lengths) - lengths
    ids = np.empty(int(lengths.sum()), np.uint32)
    ids[starts], ids[starts + 1 + roles], ids[starts + lengths - 1] = marks
    for first, own, n in ((starts + 1, role_ids, roles), (starts + 2 + roles, text_ids, texts)):
        ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
    edges = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edges, (starts + roles + 2)[trained], 1)
    np.add.at(edges, (starts + lengths - 1)[trained], -1)
    return ids, np.cumsum(edges)[:-1].astype(np.uint8), lengths


def placed(turns: DataFrame) -> DataFrame:
    """ROW, pos and start of rows (ROW, conv_id, turn, role, tie, n_tokens): places in the conversation, of turns and of tokens.

    Turns are ordered within blocks of turn numbers, and blocks by their sums, so no task sorts a whole conversation.
    """
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "tie", ROW)
    within = turns.select(ROW, "conv_id", "block", F.row_number().over(order).alias("nth"), F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "n_tokens")
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("turns"), F.sum("n_tokens").alias("tokens"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens"))
    both = within.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return both.select(ROW, (F.col("turns") + F.col("nth") - 1).alias("pos"), (F.col("tokens") + F.col("upto") - F.col("n_tokens")).alias("start"))


def format_turns(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, pos (of the turn, from 0), start (its first token's place), ids (uint32), mask (uint8) and n_tokens.

    Turns are ordered by number, a null number first, then by role and a hash of the text, so repeated rows stay and
    have a defined place. Null roles and texts are empty ones; rows of a null conversation form one conversation. Other
    columns are not read. Turns are encoded where they are; only their numbers and lengths are sorted.
    """
    named = F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text")
    keyed = turns.select(*named, F.monotonically_increasing_id().alias(ROW))  # fixed once the coded turns are written

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, marks = tokenizer(tokenizer_path, plain=True), reserved(tokenizer_path)
        for batch in rows:
            role, text = batch.column("role"), batch.column("text")
            for a, b in batches(text):
                plain = text[a:b].to_pylist()
                (role_ids, r), (text_ids, t) = tok.encode(role[a:b]), tok.encode(pa.array([escape(x) for x in plain], pa.string()))
                on = np.array([x in trained for x in role[a:b].to_pylist()], bool)
                ids, mask, lengths = splice(marks, role_ids, np.diff(r), text_ids, np.diff(t), on)
                cut = np.cumsum(lengths)[:-1]
                part = batch.slice(a, b - a)
                made = [
                    pa.array([hashlib.md5(x.encode()).digest() for x in plain], pa.binary()), pa.array([x.tobytes() for x in np.split(ids, cut)], pa.binary()),
                    pa.array([x.tobytes() for x in np.split(mask, cut)], pa.binary()), pa.array(lengths, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in (ROW, "conv_id", "turn", "role")] + made, names=[ROW, "conv_id", "turn", "role", "tie", "ids", "mask", "n_tokens"])

    schema = f"{ROW} long, conv_id long, turn long, role string, tie binary, ids binary, mask binary, n_tokens long"
    coded = materialize(in_arrow(keyed, encode, schema), "chat-turns")
    places = materialize(placed(coded.select(ROW, "conv_id", "turn", "role", "tie", "n_tokens")), "chat-places")
    return coded.join(sized(places), ROW).select("conv_id", "pos", "start", "ids", "mask", "n_tokens")


def read_turn(ids: np.ndarray, on: np.ndarray, pieces: np.ndarray, marks: tuple[int, int, int]) -> tuple[str, str, str | None, int]:
    """Role, text, the text under the mask (null if there is none) and the characters of the rendering, from the ids alone."""
    chars = lambda part: b"".join(pieces[part].tolist()).decode()
    sep = int(np.flatnonzero(ids == marks[1])[0])
    if ids[0] != marks[0] or ids[-1] != marks[2]:
        raise ValueError("not a formatted turn")
    role, text = chars(ids[1:sep]), chars(ids[sep + 1 : -1])
    loss = None if not on.any() else text if on[sep + 1 : -1].all() else chars(ids[on])
    return role, unescape(text), loss and unescape(loss), len(role) + len(text) + sum(map(len, MARKS))


def read_turns(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Back from the ids alone: conv_id, pos, role, text, loss_text (null outside the mask), formatted_chars."""

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, marks = np.array(id_bytes(tokenizer_path), object), reserved(tokenizer_path)
        for batch in rows:
            out = [read_turn(np.frombuffer(i, "<u4"), np.frombuffer(m, np.uint8) > 0, pieces, marks) for i, m in zip(batch.column("ids").to_pylist(), batch.column("mask").to_pylist(), strict=True)]
            role, text, loss, n = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("pos"), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(loss, pa.string()), pa.array(n, pa.int64())], names=["conv_id", "pos", "role", "text", "loss_text", "formatted_chars"])

    return in_arrow(formatted.select("conv_id", "pos", "ids", "mask"), decode, "conv_id long, pos long, role string, text string, loss_text string, formatted_chars long")


def digest_conversations(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a conversation, its digests taken turn by turn from the ids, as the sorted rows stream by."""

    def digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, marks = np.array(id_bytes(tokenizer_path), object), reserved(tokenizer_path)
        now, held = object(), None

        def row():
            conv, n, all_, loss, n_loss, n_chars = held
            return {"conv_id": conv, "n_turns": n, "turns_sha256": all_.hexdigest(), "loss_chars": n_loss, "loss_sha256": loss.hexdigest(), "formatted_chars": n_chars}

        for batch in rows:
            done = []
            for conv, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if conv != now:
                    if held:
                        done.append(row())
                    now, held = conv, [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, text, loss, n = read_turn(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8) > 0, pieces, marks)
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                held[3].update((loss or "").encode())
                held[4] += len(loss or "")
                held[5] += n
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.select("conv_id", "pos", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return in_arrow(ordered, digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts look like the marks.
PROBE = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return digest_conversations(format_turns(turns, path), path)
