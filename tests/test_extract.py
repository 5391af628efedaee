"""Citation extraction and address classes against expectations written by hand."""

import ipaddress
import re

import pytest
from pyspark.sql import functions as F

from provenant.functions import extract, urls

W = "https://wells.org/logs"


def links(text):
    return [u for u, _ in extract.cited(text)]


# Where a bare address ends. Each text holds one or more of them, written between bars.
PROSE = [
    "Rainfall is tabled at |https://wells.org/rain|.", "|https://wells.org/rain|, |https://wells.org/snow|; and |http://wells.org|!", "Who keeps |https://wells.org/who?day=2|?", "(as |https://wells.org/a.pdf| has it)", "<b>|https://wells.org/q#part-2|</b>",
    "a full stop inside: |https://wells.org/v1.2/x.tar.gz|.", "dots |https://wells.org/a..b/c| go on, dots |https://wells.org/a|... don't", "|https://wells.org/Depth_(well)| is balanced, (|https://wells.org/Depth|) is wrapped", "((|https://wells.org/x_(y)|))", "[|https://wells.org/list|]",
    "port |http://wells.org:8080/x|, user |http://me@wells.org/x|", "|https://bücher.wells.org/straße| and |https://wells.org/日本|", "quoted '|https://wells.org/a|' and \u201c|https://wells.org/a|\u201d and \u00ab|https://wells.org/b|\u00bb", "its owner's |https://wells.org/o'brien| page", "|HTTPS://Wells.Org/Upper|",
    "| is not part: |https://wells.org/cell| \\|", "ticks of -- |https://wells.org/a--b-| end", "|https://wells.org/a,b;c| yes", "|https://[2001:db8::7]:81/x| is a literal, and so is |http://[::1]|.", "|https://wells.org/a|\u3000wide space", "|https://wells.org/|? asks once, |https://wells.org/?a|?? twice", "tab\t|https://wells.org/t|\tend",
]
NOT_CITED = [
    "", "no address", "ftp://wells.org/a gopher://x", "https://", "https:// wells.org", "https:///path", "https://wells.org/{id}/log", "https://wells.org/log}tail", "https://wells.org/open_(bracket and", "https://under_score.org/a", "https://wells.org:99999/a", "https://-wells.org/", "https://wells.org/a\u0085b"[:0],
]


@pytest.mark.parametrize("text", PROSE)
def test_bare_addresses(text):
    plain = re.sub(r"(?<!\\)\|(?=https?:|HTTPS?:)|(?<=[^\s\\])\|", "", text)
    want = re.findall(r"(?<!\\)\|(https?:[^|]*)\|", text, re.IGNORECASE)
    assert want and links(plain) == list(dict.fromkeys(want)), plain


@pytest.mark.parametrize("text", NOT_CITED)
def test_what_is_no_address(text):
    assert links(text) == [] and links(None) == []


# Block structure: which lines are prose. S stands for an address that is shown, C for one that is cited.
BLOCKS = {
    "fence": "C1\n```sh\ncurl S1\n```\nC2",
    "fence of tildes, ticks inside": "~~~\nS1\n```\nS2\n~~~\nC1",
    "fence that is never closed": "C1\n\n```\nS1\n\nS2",
    "longer fence around a shorter one": "`````\nS1\n```\nS2\n`````\nC1",
    "closing fence takes no words": "```\nS1\n``` end\nS2\n```\nC1",
    "ticks with a tick behind are no fence": "``` a ` b\nC1",
    "fence in a quote ends with it": "> ```\n> S1\nC1",
    "fence in a list item": "1. step\n\n   ```\n   S1\n   ```\n   then C1",
    "fence of an item ends where the item does": "- ```\n  S1\n\nC1",
    "indented code": "para\n\n    S1\n\nC1",
    "an indented line goes on with its paragraph": "para\n    C1",
    "indented code in an item": "- a\n\n      S1\n\n  C1",
    "eight spaces under a one-digit item": "- a\n\n        S1",
    "an item's own indent is no code": "- a\n\n  C1\n  - b C2\n\n    C3",
    "code by tab": "para\n\n\tS1\n\nC1",
    "code at once in an item": "-     S1\n- C1",
    "quotes within quotes": "> > C1\n> C2\nC3 goes on lazily",
    "block of html": "<section>\nS1\n</section>\n\nC1",
    "html ends at a blank line only": "<p>\nS1\n\nC1",
    "script to its end tag": "<script>\nS1\n\nS2\n</script>\nC1",
    "an anchor alone on its line": "<a href='S1'>\nS2\n\nC1",
    "comment over blank lines": "<!-- S1\n\nS2 -->\nC1",
    "a lone tag of any name": "<odd-one>\nS1\n\nC1",
    "such a tag does not interrupt": "para\n<odd-one>\nC1",
    "a tag with words behind is inline": "<odd-one> C1",
    "headings": "# About C1\nC2\n===\nC3\n---\nC4",
    "rule between": "C1\n\n***\n    S1\n",
    "numbered item from 2 does not interrupt": "para\n2. C1\n    C2",
    "definition used": "Read [the log][L] now.\n\n[l]: C1 \"its title\"",
    "definition not used": "Read on.\n\n[l]: S1 \"its title\"\n[m]: <S2>\n[n]:\n  S3\n  'title'",
    "definition inside a paragraph is prose": "Read on\n[l]: C1",
    "definition with words behind is prose": "[l]: C1 more words",
    "first definition counts": "[l] and [L][]\n\n[L]: C1\n[l]: S1",
}
# Inline structure.
INLINE = {
    "link": "[log](C1)", "link with title": "[log](C1 'of wells')", "pointed": "[log](<C1>)", "spaces": "[log]( C1 )", "label is not cited": "[S1](C1)", "brackets in label": "[a [b] c](C1)", "no links in links": "[a [b](C1) c](C2)", "round brackets": "[w](C1_(x))", "unbalanced destination": "[w](S1(x",
    "image": "![chart](S1) C1", "image in a link": "[![chart](S1)](C1)", "link in an alternative text": "![see [x](S1)](S2)", "automatic": "<C1>", "anchor": '<a rel="x" href="C1">S1x</a>'.replace("S1x", "here"), "anchor in single quotes": "x <a href='C1'>", "other tags": '<img src="S1"> <link href="S2">',
    "code": "`S1` and ``S2 ` S3``", "code over a line": "`a\nS1` C1", "lone tick": "a ` C1", "ticks of other lengths": "`` C1 ` C2", "escaped tick": r"\`C1 \`".replace("C1 ", "C1 "), "escaped bracket": r"\[x](C1 )", "emphasis": "**C1** and _C2_ and ***C3***", "marks in a word stay": "C1_a_b C2__", "star in emphasis": "*see C1*",
    "entity": "C1?a=1&amp;b=2", "not an entity": "C1?a=1&b=2", "comment": "x <!-- S1 --> C1", "a template's braces": "[t](S1/%7Bid%7D)", "other schemes": "[t](mailto:x@y.z) [u](/rel)",
}


def spelled(text):
    """Letters and numbers to addresses; what is cited, in order, with what stands behind the letter."""
    address = lambda m: f"https://{'cited' if m[1] == 'C' else 'shown'}.org/{m[2]}"
    return re.sub(r"\b([CS])(\d)", address, text)


@pytest.mark.parametrize("name", [*BLOCKS, *INLINE])
def test_cited_and_shown(name):
    text = spelled((BLOCKS | INLINE)[name])
    got = links(text)
    want = set(re.findall(r"https://cited\.org/\d", text))
    assert {u[:19] for u in got} == want and not [u for u in got if "shown" in u], (text, got)


def test_exact_forms():
    assert links("[w](https://wells.org/x_(y)) https://wells.org/z?a=1&amp;b=2") == ["https://wells.org/x_(y)", "https://wells.org/z?a=1&b=2"]
    assert links(f"**[log]({W})**, **{W}/b**, _{W}/c_") == [W, f"{W}/b", f"{W}/c"]
    assert links(f"{W}/snake_case_name and {W}/a__b") == [f"{W}/snake_case_name", f"{W}/a__b"]
    assert extract.cited(f'[x]({W}) <a href="{W}/h">y</a> {W}/p {W}') == [(W, "link"), (f"{W}/h", "html"), (f"{W}/p", "bare")]
    assert links(f"[{W}/label]({W})") == [W]
    assert links(f"{W}\x1b[1;31m/red\x1b[0m end \x1b]8;;x\x07link\x1b]8;;\x1b\\") == [f"{W}/red"]
    # A sequence that is not finished takes no text with it.
    assert links(f"\x1b[12\n{W} \x1b]0;title {W}/b") == [W, f"{W}/b"]


@pytest.mark.parametrize("unit", ["[", "]", "(", "![", "[a](", "[a](b", "\x1b]", "\x1b[", "`", "` `` ", "<", "<a ", "<!--", "*", "_a*", "**a", "> ", "- ", "1. ", "https://", "https://x.org/(", "https://x.org/{", "https://x.org/'", "&", "\\", "\n", "\n- a", "[a]: ", "*a_", "~~~\n", "https://x.org/a)", '<a b="', "\t", "> - ", "[a][b", "!"])
def test_a_megabyte_of_anything_is_read_in_linear_time(unit):
    import time

    text = W + " " + unit * (1_000_000 // len(unit))
    began = time.process_time()
    extract.cited(text)
    assert time.process_time() - began < 20, unit


def test_generated_reports_cite_nothing(spark):
    from provenant.operators import capture

    rows = spark.createDataFrame([("1", "assistant", f"{capture.REPORT}\n{W}"), ("2", "user", f"{capture.REPORT}\n{W}"), ("3", "assistant", W)], "msg_id string, role string, text string")
    assert sorted(r["msg_id"] for r in capture.citations(rows).collect()) == ["2", "3"]


V4 = {"2130706433": True, "0x7f000001": True, "017700000001": True, "127.1": True, "0177.0.0.1": True, "3232235777": True, "0xa000001": True, "10.1": True, "8.8.8.8": False, "134744072": False, "1.2.3.4.5": None, "256.1.1.1": None, "08.1.1.1": None, "1.2.3": False, "site.org": None}


def test_ipv4_notations(spark):
    rows = spark.createDataFrame([(h,) for h in V4], "h string").select("h", urls.ipv4(F.col("h")).alias("n")).select("h", F.when(F.col("n").isNotNull(), urls.unsafe_ipv4(F.col("n"))).alias("u")).collect()
    assert {r["h"]: r["u"] for r in rows} == V4


def test_address_classes_are_those_of_the_registry(spark):
    four = [f"{a}.{b}.{c}.{d}" for a in (0, 1, 10, 100, 127, 128, 169, 172, 191, 192, 198, 203, 223, 224, 240, 255) for b in (0, 2, 15, 16, 18, 19, 51, 64, 128, 168, 254) for c in (0, 2, 100, 113) for d in (1, 8, 9, 10)]
    six = ["::", "::1", "::2", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "fe80::1", "fec0::1", "fc00::1", "ff02::1", "2606:4700:4700::1111", "2001:db8::1", "2001::1", "2001:200::1", "2001:20::5", "2001:3::1", "2001:4:112::1", "2002::1", "64:ff9b::1", "100::1", "4000::1", "1:2:3:4:5:6:7:8"]
    carrier = ipaddress.ip_network("100.64.0.0/10")

    def unsafe(text):
        ip = ipaddress.ip_address(text)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return ip.is_private or ip.is_reserved or ip.is_multicast or ip.is_loopback or ip.is_link_local or ip.is_unspecified or getattr(ip, "is_site_local", False) or (ip.version == 4 and ip in carrier)

    rows = spark.createDataFrame([(f"http://{h}/x",) for h in four] + [(f"http://[{h}]:80/x",) for h in six], "u string").select("u", urls.excluded_reason(F.col("u")).alias("r"))
    got = {r["u"]: r["r"] in ("unsafe_address", "exact_host") for r in rows.collect()}
    assert {u: v for u, v in got.items() if v != unsafe(u.split("/")[2].replace(":80", "").strip("[]") if "[" not in u else u[u.index("[") + 1 : u.index("]")])} == {}
    bad = spark.createDataFrame([("http://[1::2::3]/",), ("http://[12345::]/",), ("http://[1:2]/",)], "u string").select(urls.ipv6(urls.host(F.col("u"))).alias("g"))
    assert [r["g"] for r in bad.collect()] == [None] * 3
