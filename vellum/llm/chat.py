r"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole: ``<turn>role<text>text</turn>`` for each turn. Inside roles and
texts a backslash is doubled and the ``<`` of a control string gets a backslash after it, so no
control string is left in them and unescaping (drop the first of each backslash pair) restores them.
The rendered string is encoded once, with the control strings as added tokens, so that no token
straddles the edge of a text. A byte-level token stands for a known number of bytes, so running sums
give every token's place in a batch of conversations, as code points, without an object per token; a token
that holds part of a character's bytes spans the whole of it. The mask holds the tokens that lie in an
assistant's text, found by binary search of token starts in the sorted turn spans of the batch.

Defined results: null text and role are empty; turns are ordered by (turn, role, text), nulls first,
so ties go by role and text, and repeated rows are turns of their own; rows without a conversation id form
one conversation; a conversation of any length is one row and one task's work; an empty table gives no rows;
extra columns are ignored. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, tokens

OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
RENDERED = "conv_id long, n_turns long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"
#: The contract's own conversation: control strings and backslashes inside both texts.
EXTRA = r"\### Assistant: </turn> ok"


def escape(s: str) -> str:
    if "\\" not in s and "<" not in s:
        return s
    s = s.replace("\\", "\\\\")
    for mark in (OPEN, TEXT, CLOSE):
        s = s.replace(mark, "<\\" + mark[1:])
    return s


def unescape(s: str) -> str:
    import re

    return s if "\\" not in s else re.sub(r"\\(.)", r"\1", s, flags=re.S)


def render(turns, roles=("assistant",)):
    """The string, and the sorted spans of the texts whose role is in ``roles``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + TEXT, escape(text)
        at += len(head)
        if role in roles:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        parts += (head, body, CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the string."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, text = piece.removesuffix(CLOSE).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def chat_tokenizer(path: str | None):
    from tokenizers import AddedToken

    tok = tokens.load(path)
    tok.add_tokens([AddedToken(m, normalized=False) for m in (OPEN, TEXT, CLOSE)])
    return tok


class Places:
    """Where the ids of a byte-level tokenizer stand in the texts they were made of."""

    def __init__(self, tok):
        import numpy as np

        # a token of the vocabulary has a character for each byte; added tokens are written out
        added = {i: len(t.content.encode()) for i, t in tok.get_added_tokens_decoder().items()}
        self.n_bytes = np.array([added.get(i, len(tok.id_to_token(i) or "")) for i in range(tok.get_vocab_size())], np.int64)

    def of(self, texts: list[str], starts, ids):
        """First code point and the one after the last of every token, and of every text, all counted through the batch."""
        import numpy as np

        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        lead = np.concatenate([(raw & 0xC0) != 0x80, [True]])
        points = np.concatenate([[0], np.cumsum(lead[:-1])])
        end = np.cumsum(self.n_bytes[ids])
        begin = end - self.n_bytes[ids]
        ends = np.cumsum([0, *map(len, texts)])
        edges = np.concatenate([[0], end])[starts]
        if len(raw) != edges[-1] or not (points[edges] == ends).all():
            raise ValueError("the tokenizer's ids don't spell the texts")
        return points[begin] - ~lead[begin], points[end], ends


def format_batches(path: str | None, roles: tuple):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = tokens.Encoder(path, tok=chat_tokenizer(path))
        places = Places(enc.tok)
        for whole in batches:
            for b in tokens.slices(whole, 256):
                turns = b.column(1)
                flat, cut = turns.flatten(), (turns.offsets.to_numpy() - turns.offsets[0].as_py()).tolist()
                every = list(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist(), strict=True))
                texts, spans, at = [], [], 0
                for lo, hi in zip(cut, cut[1:], strict=False):
                    formatted, own = render(every[lo:hi], roles)
                    texts.append(formatted)
                    spans += [(at + s, at + e) for s, e in own]
                    at += len(formatted)
                column = pa.array(texts, pa.string())
                starts, ids = enc.encode(column)
                first, last, ends = places.of(texts, starts, ids)
                edges = np.array(spans, np.int64).reshape(-1, 2)
                k = np.searchsorted(edges[:, 0], first, "right") - 1
                mask = (k >= 0) & (first < (edges[:, 1][np.maximum(k, 0)] if len(edges) else 0))
                base = np.repeat(ends[:-1], np.diff(starts))
                offsets = pa.array(starts.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, (first - base).astype(np.int32), (last - base).astype(np.int32), mask)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(cut)), column, *lists], names=[c.split()[0] for c in RENDERED.split(", ")])
            common.give_back()

    return run


def format_chats(turns: DataFrame, tokenizer: str | None = None, roles: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation: the rendered string, its token ids and offsets, and the loss mask over tokens."""
    common.small_batches(turns.sparkSession)
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    return whole.select("conv_id", "turns").mapInArrow(format_batches(tokenizer, tuple(roles)), RENDERED)


def masked_texts(formatted: list[str], offsets, starts, ends, mask) -> list[str]:
    """What stands under each text's mask, unescaped. Tokens that follow one another under the mask are one run, so a character that several share counts once."""
    import numpy as np

    row = np.repeat(np.arange(len(formatted)), np.diff(offsets))
    same = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
    opens = np.flatnonzero(mask & ~(same & np.concatenate([[False], mask[:-1]])[: len(mask)]))
    closes = np.flatnonzero(mask & ~np.concatenate([(same & mask)[1:], [False]])[: len(mask)])
    out: list[list[str]] = [[] for _ in formatted]
    for r, a, b in zip(row[opens].tolist(), starts[opens].tolist(), ends[closes].tolist(), strict=True):
        out[r].append(formatted[r][a:b])
    return [unescape("".join(parts)) for parts in out]


def digests(batches):
    import hashlib

    import pyarrow as pa

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for whole in batches:
        for b in tokens.slices(whole, 256):
            formatted, lists = b.column(2).to_pylist(), [b.column(i) for i in (4, 5, 6)]
            offsets = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            starts, ends, mask = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            turns, loss = [parse(f) for f in formatted], masked_texts(formatted, offsets, starts, ends, mask)
            columns = [
                b.column(0),
                pa.array([len(t) for t in turns], pa.int64()),
                pa.array([sha("".join(f"{a}\n{t}\n" for a, t in own)) for own in turns], pa.string()),
                pa.array([len(x) for x in loss], pa.int64()),
                pa.array([sha(x) for x in loss], pa.string()),
                pa.array([len(f) for f in formatted], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all conversations and conversation -7, formatted and read back."""
    turns = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    return format_chats(turns.unionByName(extra)).mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The template adds 19 code points of marks to a turn, and a backslash for each backslash and each mark inside.
SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (SELECT *, length(role || text) + length(role || text) - length(replace(role || text, '\', ''))
  + len(regexp_extract_all(role, '<turn>|<text>|</turn>')) + len(regexp_extract_all(text, '<turn>|<text>|</turn>')) + 19 AS chars FROM rows)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
