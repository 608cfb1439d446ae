from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from trackwake.llm import secrets

KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)


def brute(text):
    spans = []
    for rank, (kind, regex, group, least) in enumerate(KINDS):
        for m in re.finditer(regex, text or ""):
            if len(m[group]) >= least:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s[2] for s in sorted(spans))


HEX = "0123456789abcdef" * 2
TEXTS = [
    None,
    "",
    "token=secret: hunter22longvalue",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    "PassWord:'abcdefgh' api_key=short apikey = longenough1 APIKEY=12345678",
    "😀é token=abcdefgh AKIA" + "A" * 12 + " x" + HEX + " AKIAAKIA1234",
    HEX + "0" + HEX.upper() + HEX,
    "to\u212aen=abcdefgh to\u017fecret=abcdefgh",
    "a" * 40000 + " " + "token=" + "b" * 30000,
    "password=secret=abcdefgh secret\n=abcdefgh",
]


def base_of(frame):
    return frame.select("doc_id", secrets.joined(F.col("base_spans")).alias("base")).collect()


def test_base_spans(make_docs):
    docs = make_docs(list(enumerate(TEXTS)), extra="spans owner digest")
    got = base_of(secrets.scan_secrets(docs))
    assert {r.doc_id: r.base for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_ownership_separates_examples(make_docs):
    shared, own = "Bearer " + "x" * 20, "Bearer " + "y" * 20
    rows = [(i, f"{shared} token=aaaaaaaa", "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, own + " token=bbbbbbbb", "en", "s1"), (101, own, "en", None), (102, "none", "en", "s1")]
    rows += [(100, own + " token=bbbbbbbb", "en", "s1"), (None, own, "en", None)]
    got = secrets.scan_secrets(make_docs(rows))
    by_id: dict = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(
            ([(s.kind, s.live) for s in r.spans], r.n_live, r.n_copied)
        )
    assert by_id[0] == [([("assign", False)], 0, 2)]
    assert by_id[100] == [([("bearer", True), ("assign", True)], 2, 0)] * 2
    assert by_id[101] == by_id[None] == [([("bearer", True)], 1, 0)]
    assert by_id[102] == [([], 0, 0)]
    assert secrets.scan_secrets(make_docs(rows).limit(0)).collect() == []


def test_an_example_copied_through_one_source_is_no_secret(make_docs):
    hot, own = "Bearer " + "x" * 20, "Bearer " + "y" * 20
    rows = [(i, hot, "en", "hub") for i in range(300)]
    rows += [(1000 + i, own, "en", "hub") for i in range(secrets.MAX_REPOS)]
    rows += [(1000, own, "en", "hub")]
    got = secrets.scan_secrets(make_docs(rows)).collect()
    for r in got:
        if r.doc_id < 1000:
            assert (list(r.spans), r.n_live, r.n_copied) == ([], 0, 1)
        else:
            assert [(s.live, s.n_owners, s.n_repos) for s in r.spans] == [(True, 1, secrets.MAX_REPOS)]
    assert len(got) == len(rows)


UNBOUNDED = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]{8,}@"),
)


def test_long_tokens_and_logins_are_found_whole(make_docs):
    part = "ab9_-Z" * 250
    token = f"eyJ{part}.eyJ{part}.{part}"
    texts = [
        f"{token} " + "lorem ipsum " * 90000,
        "a" * 300000 + " eyJ" * 20000 + "eyJ" * 100000 + f" {token}",
        f"jwt_{token}, auth-eyJeyJ12345678.{part}.{part}. eyJshort.{token}",
        "x://" * 50000 + "a+" * 100000 + f" ftp://{'u' * 100}:{'p' * 300}@host",
        f"9+http://me:{'q' * 201}@h {'s' * 40}://me:secretword@h HTTPs://u:12345678@",
    ]
    draw = random.Random(3)
    pieces = ["eyJ", "eyJ", "a", "ab_-cdef", "12345678", "12345678", ".", ".", " ", "://", ":", "@", "Z", "9+"]
    texts += ["".join(draw.choices(pieces, k=120)) for _ in range(1000)]
    got = secrets.scan_secrets(make_docs(list(enumerate(texts))), max_owners=10, max_repos=10**6)
    seen = 0
    for r in got.collect():
        mine = {(s.kind, s.start, s.end) for s in r.spans}
        for kind, regex in UNBOUNDED:
            # The plain regexes are too slow for the longest texts.
            if len(texts[r.doc_id]) < 100000:
                theirs = {(kind, *m.span()) for m in re.finditer(regex, texts[r.doc_id])}
                seen += len(theirs)
                assert {s for s in mine if s[0] == kind} == theirs
        if r.doc_id in (0, 1, 2):
            at = texts[r.doc_id].index(token)
            assert ("jwt", at, at + len(token)) in mine
        if r.doc_id == 3:
            at = texts[3].index("ftp://")
            assert ("url_login", at, len(texts[3]) - 4) in mine
    assert seen > 50
