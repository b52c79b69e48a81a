"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of the
turns that carry loss are intersected with the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoweave.llm.common import slices, table

HEAD, TAIL = "### ", "\n</turn>\n"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
ADDED = -7
ADDED_TEXT = "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    """No control string is left in the result: backslashes are doubled, ``###`` and ``</turn>`` are broken by one."""
    return _CONTROL.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles=("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the sorted spans of its escaped texts under loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{HEAD}{_line(role)}:\n"
        body = escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), spans


def _line(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; the inverse of ``render``."""
    turns, at = [], 0
    while at < len(rendered):
        colon = rendered.index(":\n", at + len(HEAD))  # a role's own line ends are escaped
        end = rendered.index(TAIL, colon + 2)
        turns.append((unescape(rendered[at + len(HEAD) : colon]), unescape(rendered[colon + 2 : end])))
        at = end + len(TAIL)
    return turns


def masked(spans: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(first token, last token + 1, ...)`` ranges of tokens that touch each span.

    Both lists are sorted, so each span finds its first and last token by binary search.
    """
    starts, ends = [t[0] for t in tokens], [t[1] for t in tokens]
    return [(bisect_right(ends, a), bisect_left(starts, b)) for a, b in spans if b > a]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def encode_conversation(turns: list[tuple[str, str]], path: str, loss_roles=("assistant",)) -> tuple[str, list[int], list[int], list[tuple[int, int]]]:
    """Rendered text, token ids, token loss mask (0/1), and the character spans under the mask.

    A token that reaches over a span's edge is masked in; of its characters only those inside the
    span count. Bytes of one character may be several tokens; the character then counts once.
    """
    text, spans = render(turns, loss_roles)
    e = _tokenizer(path).encode(text, add_special_tokens=False)
    offsets, mask, under = e.offsets, [0] * len(e.ids), []
    for (a, b), (first, stop) in zip([s for s in spans if s[1] > s[0]], masked(spans, offsets)):
        reach = a
        for k in range(first, stop):
            mask[k] = 1
            x, y = max(reach, offsets[k][0]), min(b, offsets[k][1])
            if x < y:
                if under and under[-1][1] == x and x > a:
                    under[-1] = (under[-1][0], y)
                else:
                    under.append((x, y))
                reach = y
    return text, e.ids, mask, under


FORMATTED = "conv_id long, formatted string, token_ids array<int>, loss_mask array<byte>, loss_spans array<struct<start:int,end:int>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_conversations(rows: DataFrame, tokenizer_path: str | None = None, loss_roles=("assistant",)) -> DataFrame:
    """One row per conversation: rendered text, token ids, token mask and character spans under loss.

    Rows are ordered by turn (equal turns by role, then text; null turns first). A null text or role
    is empty; repeated rows are repeated turns; rows with a null conv_id form one conversation; an
    empty table gives no rows. A conversation is one training example and is rendered whole, so it
    has to fit in a task; conversations are spread by key with partial collection before the shuffle.
    """
    path = tokenizer_path or default_tokenizer()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    grouped = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    flat = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = [encode_conversation(list(zip(r, t)), path, loss_roles) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.int8())), pa.array([[{"start": x, "end": y} for x, y in o[3]] for o in out], span)],
                    ["conv_id", "formatted", "token_ids", "loss_mask", "loss_spans"],
                )

    return flat.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of formatted conversations, as counts and digests."""

    def run(batches):
        for b in slices(batches):
            out = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                turns = parse(text)
                loss = unescape("".join(text[s["start"] : s["end"]] for s in spans))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations plus one whose texts hold the control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(ADDED, 0, "user", ADDED_TEXT), (ADDED, 1, "assistant", ADDED_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(added)))


ORACLE_6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
        15 + length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
        + (length(role || ' ' || text) - length(replace(role || ' ' || text, '</turn>', ''))) // 7
        + length(role) - length(replace(role, chr(10), ''))
        + coalesce(list_sum(list_transform(regexp_extract_all(role || ' ' || text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
