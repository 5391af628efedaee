"""Fill-in-the-middle examples, cut between tokens.

A token is a run of letters A-Z, or any other single code point. A text's bytes
are cut into fixed blocks, and a Fenwick tree over the blocks holds how many
tokens and how many code points begin in each. A cut after k tokens is found by
binary-lifting descent to the block in which the next token begins; only that
block is then searched. Texts of any length are cut so, without a list of their
tokens.

Where an example is cut, and which form it takes, follow from a hash of its id
alone, so that reruns and other orders of the rows agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 examples, how many are transformed, and how many of these have the suffix first.
RATE, SPM, SEED = 90, 20, "1"
BLOCK = 4096
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def fenwick(values: np.ndarray) -> np.ndarray:
    """The tree over rows of values: node i, from 1, sums the i & -i rows that end with row i."""
    tree = np.concatenate([np.zeros((1, values.shape[1]), dtype=np.int64), values])
    step = 1
    while step < len(tree):
        nodes = np.arange(step, len(tree) - step, 2 * step)
        tree[nodes + step] += tree[nodes]
        step *= 2
    return tree


class Blocks:
    """Token and code-point counts of a text in UTF-8."""

    def __init__(self, text: bytes, block: int = BLOCK):
        data = np.frombuffer(text, dtype=np.uint8)
        self.block, letter = block, _LETTER[data]
        self.point = (data & 0xC0) != 0x80
        self.token = self.point.copy()
        self.token[1:] &= ~(letter[1:] & letter[:-1])
        starts = np.arange(0, len(data), block)
        counts = np.stack([np.add.reduceat(x, starts, dtype=np.int64) for x in (self.token, self.point)], axis=1) if len(data) else np.zeros((0, 2), dtype=np.int64)
        self.tree = fenwick(counts)
        self.n = int(counts[:, 0].sum())

    def chars_before(self, k: int) -> int:
        """Code points of the first k tokens."""
        at, tokens, chars, step = 0, 0, 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            node = at + step
            if node < len(self.tree) and tokens + self.tree[node, 0] <= k:
                at, tokens, chars = node, tokens + int(self.tree[node, 0]), chars + int(self.tree[node, 1])
            step >>= 1
        here = slice(at * self.block, (at + 1) * self.block)
        begins = np.flatnonzero(self.token[here])
        return chars + (int(self.point[here][: begins[k - tokens]].sum()) if k - tokens < len(begins) else 0)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "prefix_chars", "middle_chars")]))
def cuts(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """The tokens of UTF-8 text, and the code points before the first and between the two cuts, which are numbers modulo one more than the tokens."""
    out = []
    for body, a, b in zip(text, first, second, strict=True):
        blocks = Blocks(body)
        low, high = sorted((int(a) % (blocks.n + 1), int(b) % (blocks.n + 1)))
        start = blocks.chars_before(low)
        out.append((blocks.n, start, blocks.chars_before(high) - start))
    return pd.DataFrame(out, columns=["n", "prefix_chars", "middle_chars"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts tokens; form is plain, psm or spm. Plain texts are the empty ones,
    those that hold a marker, and the share that rate leaves; their output is
    the text and their lengths are null. A null text is empty; a null id hashes
    as no digits; rows that repeat an id are cut by the same numbers. Other
    columns are not read; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body.alias("text"), key.alias("key"))
    number = lambda k: F.conv(F.substring("key", 8 * k - 7, 8), 16, 10).cast("long")
    cut = rows.select("doc_id", "text", "key", cuts(F.col("text").cast("binary"), number(1), number(2)).alias("cut"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (number(3) % 100 >= rate), "plain").when(number(4) % 100 < spm, "spm").otherwise("psm")
    formed = cut.select("doc_id", "text", "cut.n", form.alias("form"), F.col("cut.prefix_chars").alias("p"), F.col("cut.middle_chars").alias("m"))
    piece = lambda start, size: F.substring(F.col("text"), start.cast("int"), size.cast("int"))
    prefix, middle = piece(F.lit(1), F.col("p")), piece(F.col("p") + 1, F.col("m"))
    suffix = piece(F.col("p") + F.col("m") + 1, F.length("text"))
    p, s, m = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    made = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cut_only = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return formed.select("doc_id", "n", "form", cut_only("p").alias("prefix_chars"), cut_only("m").alias("middle_chars"), made.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker can begin or end inside another, so each stands where it was put."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring(F.substring_index(head, SUFFIX, 1), len(PREFIX) + 1, 1 << 30), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring(F.substring_index(head, PREFIX, 1), len(SUFFIX) + 1, 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
