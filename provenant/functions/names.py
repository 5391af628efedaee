"""Host names in other scripts, as resolvers look them up: Nameprep (RFC 3491) and Punycode (RFC 3492) of each label."""

from __future__ import annotations

import re
import stringprep
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOTS = re.compile("[.。．｡]")
_LABEL = re.compile(r"(?!-)[a-z0-9-]{1,63}(?<!-)")
_BANNED = (
    stringprep.in_table_c12, stringprep.in_table_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6,
    stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9, stringprep.in_table_a1,
)


def prepared(label: str) -> str | None:
    """Mapped to lower case, composed, and without what is mapped to nothing; None where a character is banned or directions are mixed."""
    kept = "".join(stringprep.map_table_b2(c) for c in label if not stringprep.in_table_b1(c))
    made = unicodedata.ucd_3_2_0.normalize("NFKC", kept)
    if any(test(c) for c in made for test in _BANNED):
        return None
    right = [stringprep.in_table_d1(c) for c in made]
    if any(right) and (any(map(stringprep.in_table_d2, made)) or not (right[0] and right[-1])):
        return None
    return made


def encoded(label: str) -> str:
    """A label with characters beyond ASCII in Punycode, behind its prefix; any other as it is."""
    return label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii")


def ascii_name(host: str | None) -> str | None:
    """The ASCII form of a host name; None where it has none: an empty or over-long label, a banned character, over 253 in all. A closing dot stays."""
    if not host:
        return None
    labels = _DOTS.split(host)
    end = "." if labels[-1] == "" and len(labels) > 1 else ""
    out = []
    for label in labels[: len(labels) - bool(end)]:
        made = prepared(label)
        if not made or (not made.isascii() and made.startswith("xn--")):
            return None
        made = encoded(made)
        if not _LABEL.fullmatch(made):
            return None
        out.append(made)
    name = ".".join(out)
    return name + end if len(name) <= 253 else None


@F.pandas_udf(T.StringType())
def ascii_names(host: pd.Series) -> pd.Series:
    """ascii_name of a column. Give it null for names that are ASCII already: those need no Python."""
    return host.map(ascii_name, na_action="ignore")
