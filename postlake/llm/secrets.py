"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for candidate credentials. Candidates are counted over the whole corpus by the hash of their
value: in how many distinct repositories and under how many distinct owners each value occurs. A value that many owners
hold is a widely copied example; one that a single owner holds in few repositories and that looks random is marked live.

Kinds: assign, access and hex are the base; jwt, key_block, prefixed and url_login are candidates besides; a live
verdict is a span of its own kind over its candidate. A base match that fails its length is dropped and not retried.

Frequencies are sums of distinct (value, repository, owner), combined in map tasks; only values above the bound for
examples go back to the candidates, salted, since one example key may stand in a third of all documents. Values leave
the scan as SHA-256 only.

Defined results: a null text counts as empty; a null owner or repository counts as one of its own; repeated rows give a
row each; a text of any length is scanned whole, in time linear in it; other columns are not looked at; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_lookup

KINDS = ("assign", "access", "hex", "jwt", "key_block", "prefixed", "url_login", "live")
EXAMPLE_OWNERS = 3
LIVE_REPOS = 2
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are matched whole, so this is: all runs, short ones dropped
_MORE = (
    ("key_block", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s{0,4}([A-Za-z0-9+/=\s]{16,}+)"), 1),
    ("prefixed", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"), 0),
    ("url_login", re.compile(r"://[A-Za-z0-9._-]{1,64}:([^\s/@:]{6,128})@"), 1),
)
_RUN = re.compile(r"[A-Za-z0-9_-]+")
_GATES = {"key_block": "PRIVATE KEY", "prefixed": "_", "url_login": "://"}
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])


def looks_random(value: str) -> bool:
    """Long, mixed of letters and digits, and of high entropy a character."""
    if len(value) < 16 or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= 3.0


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of three runs of letters, digits, - and _ with dots between: the first holds eyJ, the second begins with it. Each run is looked at once."""
    if "eyJ" not in text:
        return
    head = payload = None
    for m in _RUN.finditer(text):
        start, end = m.span()
        joined = payload is not None and start == payload[1] + 1 and text[start - 1] == "."
        if joined and head is not None and end - start >= 8:
            yield head, end
            head = payload = None
            continue
        head = None
        if joined and text.startswith("eyJ", start) and end - start >= 11:  # the second of three, if the run before holds a beginning
            at = text.find("eyJ", payload[0], payload[1])
            head = at if at >= 0 and payload[1] - at >= 11 else None
        payload = (start, end)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in order of start, then kind; ends are exclusive, places are code points."""
    found = [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    found += [(KINDS.index("jwt"), start, end, text[start:end]) for start, end in web_tokens(text)]
    for name, pattern, group in _MORE:
        if _GATES[name] in text:
            found += [(KINDS.index(name), *m.span(), m[group]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda c: (c[1], c[0], c[2]))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, digests, counts = [], [], [[], [], []]
        for text in batch.column(1):
            own = candidates(text.as_py() or "")
            base = [c for c in own if c[0] < 3]
            for k in range(3):
                counts[k].append(sum(c[0] == k for c in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append([{"kind": c[0], "start": c[1], "end": c[2], "value": hashlib.sha256(c[3].encode()).hexdigest(), "random": looks_random(c[3])} for c in own])
        cols = [batch.column(0), batch.column(2), batch.column(3), batch.column(4), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans, pa.list_(_SPAN))]
        yield pa.record_batch(cols, names=["doc_id", "owner", "repo", "uid", "n_assign", "n_access", "n_hex", "base_sha256", "cands"])


def _name(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), k + 1)


def ownership(cands: DataFrame) -> DataFrame:
    """cands: value, owner, repo. Distinct owners and repositories of each value."""
    each = cands.select("value", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repo"), F.lit("")).alias("repo")).distinct()
    owners = each.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"))
    repos = each.select("value", "repo").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_repos"))
    return owners.join(repos, "value")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, example_owners: int = EXAMPLE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found.

    owner and repo tell whose a document is (default: source, and source with lang). found lists every candidate with
    its numbers of owners and repositories and its verdict: live, example, or shared.
    """
    owner = F.col("source") if owner is None else owner
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  a null is a name of its own
    repo = F.concat(part("source"), F.lit("/"), part("lang")) if repo is None else repo
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.monotonically_increasing_id().alias("uid"))
    span = "struct<kind: int, start: long, end: long, value: string, random: boolean>"
    scanned = materialize(own.mapInArrow(_scan, f"doc_id long, owner string, repo string, uid long, n_assign long, n_access long, n_hex long, base_sha256 string, cands array<{span}>"))
    cands = scanned.select("uid", "owner", "repo", F.explode("cands").alias("c")).select("uid", "owner", "repo", "c.*")
    often = ownership(cands).where((F.col("n_owners") > 1) | (F.col("n_repos") > 1))
    judged = salted_lookup(cands, often, ["value"], "uid").fillna(1, ["n_owners", "n_repos"])
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when((F.col("n_owners") == 1) & (F.col("n_repos") <= live_repos) & F.col("random"), "live").otherwise("shared")
    found = F.array_sort(F.collect_list(F.struct("start", "kind", "end", verdict.alias("verdict"), "n_owners", "n_repos", "value")))
    rows = scanned.drop("cands", "owner", "repo").join(judged.groupBy("uid").agg(found.alias("found")), "uid", "left")
    live = F.filter("found", lambda c: c["verdict"] == "live")
    every = F.array_sort(F.concat(F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))), F.transform(live, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))))
    text = F.coalesce(F.array_join(F.transform(every, lambda c: F.concat_ws(":", _name(c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ","), F.lit(""))
    count = lambda v: F.coalesce(F.size(F.filter("found", lambda c: c["verdict"] == v)), F.lit(0)).cast("long")
    listed = F.transform("found", lambda c: F.struct(_name(c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["verdict"].alias("verdict"), c["n_owners"].alias("n_owners"), c["n_repos"].alias("n_repos"), c["value"].alias("value_sha256")))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.when(F.col("found").isNull(), 0).otherwise(count("live")).cast("long").alias("n_live"), F.when(F.col("found").isNull(), 0).otherwise(count("example")).cast("long").alias("n_example"), listed.alias("found"))
