"""Chat formatting at token level.

Every turn becomes `START role SEP text END`, where START, SEP and END are ids beyond the tokenizer's
vocabulary: role and text are encoded on their own, so no text can produce a control id. In the readable form
the same marks are strings, and such strings inside a role or text are escaped: `<|`, with any number of
backslashes between its two characters, gets one more backslash. Undoing that takes one away, so the escape is
reversible for every text. Masks are prefix sums of +1 where a learned span begins and -1 where it ends.

Defined cases: a null text or role is empty; a null turn comes first; rows that tie in `turn` are ordered by role,
then text, and all are kept (a repeated row is a repeated turn); a null conv_id is a conversation of its own; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import grouped, map_rows, text_of

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
TOKENIZER = "byte_bpe_50k.json"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def assemble(conversations: DataFrame, path: str | None = None, learn: str = "assistant", learn_end: bool = True) -> DataFrame:
    """One row per turn: conv_id, turn, turn_index, token_start (tokens of the conversation before it), ids,
    loss (0 or 1 per id), formatted. Rows of a conversation lie together and in order in the result; a
    conversation of any length is a stream of its turns. Texts of turns with the role `learn` are under the
    loss, and the END after them if `learn_end`."""
    where = path

    def encode():
        tok = tokenizer(where or default_path())
        start, sep, end = (tok.get_vocab_size() + k for k in range(3))

        def rows(conv, turn, role, text):
            role, text = [escape(r) for r in role], [escape(t) for t in text]
            heads = [e.ids for e in tok.encode_batch_fast(role, add_special_tokens=False)]
            bodies = [e.ids for e in tok.encode_batch_fast(text, add_special_tokens=False)]
            for c, t, r, x, head, body in zip(conv, turn, role, text, heads, bodies):
                ids = [start, *head, sep, *body, end]
                steps = np.zeros(len(ids) + 1, np.int8)
                if r == learn:
                    begin = len(head) + 2
                    steps[begin] += 1
                    steps[begin + len(body) + learn_end] -= 1
                yield c, t, r, x, ids, np.cumsum(steps[:-1]).tolist(), f"{MARKS[0]}{r}{MARKS[1]}{x}{MARKS[2]}"
        return rows

    def place():
        def rows(key, parts):
            at = index = 0
            for part in parts:
                for turn, ids, loss, formatted in zip(*[part.column(k).to_pylist() for k in (1, 4, 5, 6)]):
                    yield key[0], turn, index, at, ids, loss, formatted
                    at, index = at + len(ids), index + 1
        return rows

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 text_of("role").alias("role"), text_of().alias("text"))
    encoded = map_rows(turns, encode, "conv_id long, turn long, role string, text string, ids array<int>, loss array<int>, formatted string")
    return grouped(encoded, ["conv_id"], ["turn", "role", "text"], place,
                   "conv_id long, turn long, turn_index long, token_start long, ids array<int>, loss array<int>, formatted string")


def read_back(assembled: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each conversation, decoded from the ids and masks that `assemble` returned: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens."""
    where = path

    def digest():
        tok = tokenizer(where or default_path())
        first = tok.get_vocab_size()

        def rows(key, parts):
            turns, learned = hashlib.sha256(), hashlib.sha256()
            n = chars = formatted = tokens = masked = 0
            for part in parts:
                for ids, loss, text in zip(*[part.column(k).to_pylist() for k in (4, 5, 6)]):
                    sep = ids.index(first + 1)
                    role, body = (unescape(x) for x in tok.decode_batch([ids[1:sep], ids[sep + 1:-1]], skip_special_tokens=False))
                    under = unescape(tok.decode([i for i, m in zip(ids, loss) if m and i < first], skip_special_tokens=False))
                    turns.update(f"{role}\n{body}\n".encode())
                    learned.update(under.encode())
                    n, chars, formatted = n + 1, chars + len(under), formatted + len(text)
                    tokens, masked = tokens + len(ids), masked + sum(loss)
            yield key[0], n, turns.hexdigest(), chars, learned.hexdigest(), formatted, tokens, masked
        return rows

    return grouped(assembled, ["conv_id"], [], digest,
                   "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                   "formatted_chars long, n_tokens long, loss_tokens long", sort=False)
