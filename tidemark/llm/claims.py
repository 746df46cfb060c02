"""Claims of patent texts, and hashed features of claims."""

from __future__ import annotations

import re
from bisect import bisect_left
from zlib import crc32

# The headings under which offices print claims.
HEADINGS = ("What is claimed", "Patentanspr", "Revendications", "权利要求书")

_BREAK = re.compile("\\r\\n?|[\\x0b\\x0c\\x85\\u2028\\u2029]")
_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060\\ufeff]")
_BLANKS = re.compile("[\\t\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000][ \\t\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]*| [ \\t\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]+")
_HYPHENATED = re.compile(r"- ?\n(?=\w)")
#: French claims refer to others as "revendications 1 à 3", so that heading counts only with a capital.
_HEADING = re.compile(
    r"W(?i:hat ?is ?claimed ?is ?:?)|w(?i:hat ?is ?claimed ?is ?:?)|P(?i:atentanspr[^\s\d]{1,6})(?=\s+\d)|p(?i:atentanspr[^\s\d]{1,6})(?=\s+\d)|Revendications(?=\s+\d)|REVENDICATIONS(?=\s+\d)|权利要求书(?!\w)"
)
_NUMBER = re.compile(r"\d{1,3}\s?[.．]\s+(?=[\"'(]?[^\W\d_])")
_INSIDE = re.compile(r"(?:[A-Za-z\d]|\d[.,])\Z")
#: Before a claim's number: a line's start or a closing mark.
_OPEN = re.compile(r"(?:\A|\n|[.。;；:：%书]) *\Z")
#: Before a number that only refers to something.
_REFERS = re.compile(r"(?i:\b(?:examples?|figs?\.?|figures?|tables?|claims?|nos?[.:]?|beispiel|abb\.?|tabelle|anspr[uü]che?n?|exemple|tableau)|revendications?|实施例|图|表|要求)\s*\Z")
#: Before a displaced number: a short run of words from the line's start, as machine translation leaves it.
_LED = re.compile(r"\n *((?:[^\W\d_]+[ '’-]+){1,8})\Z")
_CLAIM_LIKE = re.compile(
    r"(?i:\bclaims?\s*\d|anspr[uü]che?n?\s*\d|revendications?\s*\d|\b(?:compris|includ|consist|umfass|comprenant|comportant|wherein|characteri[sz]ed|gekennzeichnet|caract[ée]ris))|权利要求\s*\d|包括|包含|其特征在于"
)
#: A claim ends at a numbered paragraph of the description, at a line's end after a closing mark, and at a blank line unless
#: it plainly cuts the claim in two. A claim is one sentence, so another one in the line is description text.
_CLAIM_ENDS = re.compile(
    r"\n(?: ?\[\d{4}\]| ?SEQUENCE LISTING|(?<![,;:，；：]\n)(?<![,;:，；：] \n) ?\n(?! ?[^\W\d_A-ZÀ-Þ一-鿿]))"
    r"|[.。．…](?:(?=[^\w\n]*\n|\s*<\|endoftext\|>\n|\s*\d+\n)|(?<=[a-zß-ÿ][a-zß-ÿ]\.)(?<!\bbzw\.)(?<!\bvgl\.)(?<!\bca\.)(?<!\bresp\.)(?<!\betc\.)(?<!\bapprox\.)(?= [A-ZÀ-Þ])|(?<=%\.)(?= [A-ZÀ-Þ])|(?<=。)(?= ?[^\W\d_]))"
)
_CJK = re.compile(r"[一-鿿]+")
_WORD = re.compile(r"[^\W\d_]+")


def tidy(text: str) -> str:
    """One kind of blank and line end, no invisible characters, words put together again at line ends."""
    return _HYPHENATED.sub("", _BLANKS.sub(" ", _INVISIBLE.sub("", _BREAK.sub("\n", text))))


def _ended(claim: str) -> str:
    end = _CLAIM_ENDS.search(claim)
    return (claim[: end.start() + (end[0] in ".。．…")] if end else claim).strip()


def _numbered(text: str, headings: list[tuple[int, int]]) -> list[str]:
    """The numbered paragraphs of claims.

    After the last heading, any number in a paragraph's place counts (anywhere, if there is no heading). Before it, or after
    a run of words, a number counts whose text reads like a claim; before it also one that the numbers after it lack.
    """
    heading = headings[-1][1] if headings else 0
    stops, starts = [start for start, _ in headings], []
    for m in _NUMBER.finditer(text):
        before = text[max(0, m.start() - 20) : m.start()]
        first = any(not text[end : m.start()].strip() for _, end in headings if end <= m.start() <= end + 9)
        if first or not _INSIDE.search(before) and not _REFERS.search(before):
            placed = first or bool(_OPEN.search(before))
            led = None if placed else _LED.search(text[max(0, m.start() - 120) : m.start()] if m.start() > 120 else "\n" + text[: m.start()])
            starts.append((m.start() - len(led[1]) if led else m.start(), m, led[1] if led else "", placed))
    stops = sorted([*stops, *(at for at, *_ in starts), len(text)])
    claims = []
    for _, m, led, placed in starts:
        claim = _ended(text[m.end() : stops[bisect_left(stops, m.end())]])
        sure = placed and m.start() >= heading
        claims.append((sure, placed, int(re.match(r"\d+", m[0])[0]), led + claim if claim[:1].islower() else claim))
    known = {number for sure, _, number, _ in claims if sure}
    lacking = set(range(1, max(known, default=0))) - known
    return [claim for sure, placed, number, claim in claims if claim and (sure or placed and number in lacking or _CLAIM_LIKE.search(claim))]


def claims_of(text: str | None) -> list[str]:
    """The numbered claims of the text, wherever they stand; without a heading, all numbered paragraphs."""
    if not text:
        return []
    text = tidy(text)
    headings = [m.span() for m in _HEADING.finditer(text)]
    return _numbered(text, headings) or (_numbered(text, []) if headings else [])


def features_of(claims: list[str], memory: dict[str, int], bits: int) -> set[int]:
    """Hash buckets of the distinct words, word pairs and CJK 2- to 4-grams of the claims."""
    mask, out = (1 << bits) - 1, set()
    for claim in claims:
        claim = claim.lower()
        runs = _CJK.findall(claim)
        grams = [run[i : i + n] for run in runs for n in (2, 3, 4) for i in range(len(run) - n + 1)]
        words = _WORD.findall(_CJK.sub(" | ", claim) if runs else claim)
        grams += [w for w in words if len(w) > 2]
        grams += [f"{a} {b}" for a, b in zip(words, words[1:])]
        for g in grams:
            bucket = memory.get(g)
            if bucket is None:
                if len(memory) > 500_000:
                    memory.clear()
                bucket = memory[g] = crc32(g.encode()) & mask
            out.add(bucket)
    return out
