"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal
tokens that every match must contain. Each rule is filed under the one of its
tokens that the fewest URLs have; a URL looks up its own tokens and runs only
the regular expressions filed there.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, map_batches, picked, struct_of

#: Characters of a token: digits, a-z and whatever is not ASCII.
_TOKEN_CHARS = "0-9a-z\u0080-\U0010ffff"
_TOKEN = re.compile(f"[{_TOKEN_CHARS}]+")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_TO_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rules go to every executor, so their total length is bounded.
MAX_RULE_CHARS = 32 << 20


@dataclass(frozen=True)
class UrlRule:
    """``explicit`` rules go before the others; among them the longest ``name`` wins."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    explicit: bool


def host_rule(rule: str, action: str) -> UrlRule:
    """``host/path``: fits the host and its subdomains if the path starts with ``/path``."""
    host, slash, path = rule.partition("/")
    host = host.translate(_TO_LOWER)
    whole = f"{host}{slash}{path}"
    found = [m for m in _TOKEN.finditer(whole.translate(_TO_LOWER)) if m.end() < len(whole) or not slash]
    ending = "" if slash else r"(?=/|\Z)"
    return UrlRule(rule, action, r"\A(?:[^/]*\.)?" + re.escape(whole) + ending, tuple(m[0] for m in found), True)


_PARTS = {"*": ".*", "^": f"(?:[^{_TOKEN_CHARS}]|\\A|\\Z)"}


def pattern_rule(pattern: str, action: str) -> UrlRule:
    """A pattern in lower case, for the lower-cased ``host + path``.

    ``*`` stands for any run, ``^`` for a separator or an end, ``|`` in front
    for the host's beginning and at the end for the path's end, the rest for itself.
    """
    begin, end = pattern.startswith("|"), pattern.endswith("|")
    bare = pattern[begin : len(pattern) - end]
    regex = "(?s)" + "\\A" * begin + "".join(_PARTS.get(c) or re.escape(c) for c in bare) + "\\Z" * end
    bounded = [m[0] for m in _TOKEN.finditer(bare) if (bare[m.start() - 1] != "*" if m.start() else begin) and (bare[m.end()] != "*" if m.end() < len(bare) else end)]
    return UrlRule(pattern, action, regex, tuple(bounded), False)


#: The host rules of the query.
HOST_RULES = (
    host_rule("com/en/", "block"),
    host_rule("example.com/en/7", "allow"),
    host_rule("net/de/", "allow"),
    host_rule("example.net/de/8", "block"),
    host_rule("org/es/", "block"),
)
#: Patterns of gambling, adult, advertising, tracking, malware and spam hosts or paths.
BLOCKED = (
    "^adult^", "^ads^", "^bets^", "^casino^", "^malware^", "^phishing^", "^pills^", "^poker^", "^porn^", "^spam^", "^viagra^", "^warez^", "^keygen^",
    "^free^spins^", "^sports^betting^", "^live^cams^", "^adult^chat^", "^online^pharmacy^", "^no^prescription^", "^buy^followers^", "^payday^loans^", "^essay^writing^service^",
    "^click^track^", "^track^pixel^", "^ad^banner^", "^pop^under^", "^affiliate^redirect^", "^session^replay^", "|ads.*^click^", "|track.*^pixel^", "|adserver.*^view^",
    "^crack*^download^", "^serial*^keys^", "^free^download*.exe|", "^update*.scr|", "^verify*^account^login^", "^wallet^recovery^", "^link^farm^", "^tag^cloud^page^", "^search^results^|",
)
#: Patterns that are longer than those of BLOCKED that they except.
ALLOWED = ("^responsible^gambling^casino^", "^addiction^help^poker^", "^health^topics^pills^", "^security^advice^phishing^", "^stop^spam^advice^", "^malware^removal^guide^")
PATTERN_RULES = (*(pattern_rule(x, "block") for x in BLOCKED), *(pattern_rule(x, "allow") for x in ALLOWED))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    m = _URL.search(url or "")
    return (m[1].translate(_TO_LOWER), m[2]) if m else ("", "")


def url_tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall((host + path).translate(_TO_LOWER)))


class RuleIndex:
    """Rules filed under their rarest token; those without a token are always tried."""

    def __init__(self, rules: Sequence[UrlRule], counts: dict[str, int]):
        self.rules = sorted(set(rules), key=lambda r: (not r.explicit, -len(r.name), r.name, r.action))
        self.regexes = [re.compile(r.regex) for r in self.rules]
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for i, r in enumerate(self.rules):
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
            else:
                self.always.append(i)

    def candidates(self, host: str, path: str) -> list[int]:
        """In order of precedence."""
        return sorted([*self.always, *(i for t in url_tokens(host, path) & self.by_token.keys() for i in self.by_token[t])])

    def first(self, host: str, path: str) -> UrlRule | None:
        whole = host + path
        lower = whole.translate(_TO_LOWER)
        return next((self.rules[i] for i in self.candidates(host, path) if self.regexes[i].search(whole if self.rules[i].explicit else lower)), None)


def token_counts(pages: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of ``tokens`` is; the result has at most as many entries as ``tokens``."""
    wanted = frozenset(tokens)

    def run(batch):
        found = Counter(t for u in batch.column(0).to_pylist() for t in url_tokens(*split_url(u)) & wanted)
        return {"token": list(found.keys()), "n": list(found.values())}

    counted = map_batches(picked(pages, url=url_col), struct_of(token="string", n="long"), run).groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule] = HOST_RULES + PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col``, host, path, rule (an explicit rule's name or null), pattern (the other kind) and verdict.

    One row per input row, so null ids, ties and repeated rows stay; a null URL
    has empty host and path and the verdict of the rules that fit those, else
    ``default``. Of explicit rules the longest wins, then the first by name; of
    patterns too, which see A-Z in lower case.
    Other columns are not read.
    """
    if sum(len(r.regex) + len(r.name) for r in rules) > MAX_RULE_CHARS:
        raise ValueError(f"the rules have more than {MAX_RULE_CHARS} characters")
    counts = token_counts(pages, url_col, {t for r in rules for t in r.tokens})
    rules, index = tuple(rules), []

    def run(batch):
        if not index:
            index.append(RuleIndex(rules, counts))
        out = {k: [] for k in ("host", "path", "rule", "pattern", "verdict")}
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            r = index[0].first(host, path)
            row = (host, path, r.name if r and r.explicit else None, r.name if r and not r.explicit else None, r.action if r else default)
            for k, v in zip(out, row):
                out[k].append(v)
        return {"__id": batch.column(0)} | out

    rows = picked(pages, __id=id_col, __url=url_col)
    kinds = struct_of(__id=kind_of(rows, "__id"), **dict.fromkeys(("host", "path", "rule", "pattern", "verdict"), "string"))
    return map_batches(rows, kinds, run).withColumnRenamed("__id", id_col)
