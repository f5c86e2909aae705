"""Secrets against Python's own regular expressions on every text."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from prismata.llm import secret_scan
from prismata.llm.trigrams import derive

from .fixtures import SCHEMA, edge_docs, no_docs

KEY = "AKIA" + "ABCDEFGHIJKLMNOP2345"
TEXTS = [
    None,
    "",
    "nothing to see",
    f"key {KEY} and password: hunter22 then token='abc' tokenX",
    "PASSWORD = \"S3cr3t/+=.\" api_key:abcdef apikey=abcdefg API-KEY: abcdefg",
    "🗼 secret=ünsafe secret=abcdef🗼 " + "deadbeef" * 4 + " " + "0" * 23,
    "password=secret=token=abcdefgh",
    "f" * 24 + "g" + "f" * 30,
    KEY + KEY.lower() + "AKIA" + "A" * 15 + " AKIA" + "A" * 16,
    "ghp_" + "a1B2" * 9 + " xoxb-1234567890-abc eyJabcdefgh12.eyJabcdefgh34.sigsigsig -----BEGIN RSA PRIVATE KEY-----",
    "passwd:\nabcdefgh passwd:  abcdefgh secret ' = 'abcdef",
    "secret:" + "a" * 100_000,
]
# the base rules as the contract states them
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_base_spans_match_brute_force(spark, small_dir):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[2] == k for w in want) for k in ("assign", "access", "hex")], t
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert set(filter(None, line.split(","))) <= set(r.spans.split(",")), t


def test_further_rules_are_found(spark):
    docs = spark.createDataFrame([(1, TEXTS[9], None, None)], SCHEMA)
    kinds = [s.split(":")[0] for s in secret_scan.scan(docs).first().spans.split(",")]
    assert kinds == ["github", "slack", "jwt", "pem"]


def test_edges_and_empty_table(spark):
    got = secret_scan.scan(edge_docs(spark)).collect()
    assert len(got) == edge_docs(spark).count()
    assert secret_scan.scan(no_docs(spark)).count() == 0


def test_redact_masks_and_keeps_rows(spark):
    docs = edge_docs(spark)
    assert sorted(map(str, secret_scan.redact(docs).collect())) == sorted(map(str, docs.collect()))
    own = spark.createDataFrame([(1, TEXTS[3], "en", "web", len(TEXTS[3]), "mine"), (2, None, "en", "web", None, "mine")], SCHEMA + ", n_chars long, _key string")
    clean = {r.doc_id: r for r in secret_scan.redact(own).collect()}
    assert clean[1].text == "key [SECRET] and [SECRET] then token='abc' tokenX"
    assert clean[1].n_chars == len(clean[1].text) and clean[1]._key == "mine"
    assert clean[2].text is None and clean[2].n_chars is None
    assert not any(s for s in (r.spans for r in secret_scan.scan(secret_scan.redact(own)).collect()))


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_every_match_fulfils_its_trigram_query(data):
    rule = data.draw(st.sampled_from(secret_scan.RULES))
    text = data.draw(st.from_regex(re.compile(rule.pattern, (re.I | re.A) if rule.ignore_case else re.A))).lower()
    for clause in derive(rule.pattern, rule.ignore_case):
        assert any(all(t in text for t in alternative) for alternative in clause)


def test_rules_without_trigrams_scan_everything():
    assert derive(r"[0-9a-f]{24,}") == []
    assert derive(r"ab|cde") == []
    assert derive(r"AKIA[A-Z0-9]+")[0] == [frozenset({"aki", "kia"})]
