"""Secret scans both ways: planted secrets of many forms are found, and what merely looks long is left alone."""

import base64
import os
import random
import re
import string
import uuid

import pytest

from graphloom.llm import secret_scan

SF = "/root/testdata/sf0.001"
LETTERS, LOWER, DIGITS = string.ascii_letters, string.ascii_lowercase, string.digits
CONTEXTS = ["Authorization: Bearer {}\n", "the token we were given last week is, as far as I remember and if nobody has changed it in the meantime, {} for all of us\n", "my passphrase {} end", "x\nprivate key = {}\n"]
KINDS = {
    "letters of 40": lambda r: draw(r, LETTERS, 40), "letters of 20": lambda r: draw(r, LETTERS, 20), "lower-case letters": lambda r: draw(r, LOWER, 40), "base64": lambda r: draw(r, LETTERS + DIGITS + "+/", 24),
    "base36": lambda r: draw(r, LOWER + DIGITS, 16), "url-safe": lambda r: draw(r, LETTERS + DIGITS + "-_", 32), "upper hex": lambda r: draw(r, "0123456789ABCDEF", 32),
    "signed": lambda r: "hT$9" + draw(r, LETTERS + DIGITS + "!@#$%^&*", 15), "short signed": lambda r: "x!7K" + draw(r, LETTERS + DIGITS + "!@#$%^&*", 9),
}
NAMES = secret_scan.IDENTIFIERS.split() + "linux gnu python packages share local users project report final customer invoice backup archive release september monday quick brown jumps over".split()
BENIGN = {
    "names": lambda r: "_".join(r.choice(NAMES) for _ in range(r.randint(3, 6))), "camel case": lambda r: "".join(r.choice(NAMES).capitalize() for _ in range(r.randint(3, 6))),
    "paths": lambda r: "/" + "/".join(r.choice(["usr", "lib", "x86_64-linux-gnu", "python3.11", "site-packages", "home", "etc", "libstdc++6", "var", "opt", *NAMES]) for _ in range(r.randint(4, 7))),
    "dates": lambda r: f"20{r.randint(10, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-{r.randint(0, 59):02}Z_{r.choice(NAMES)}_{r.randint(0, 999999):06}",
    "uuids": lambda r: str(uuid.UUID(int=r.getrandbits(128))), "upper uuids": lambda r: str(uuid.UUID(int=r.getrandbits(128))).upper(), "checksums": lambda r: "sha256-" + base64.b64encode(r.randbytes(32)).decode(),
    "versions": lambda r: f"{r.choice(NAMES)}-{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}-{r.choice(NAMES)}-x86_64", "numbers": lambda r: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(1000000, 9999999)}-{r.randint(10, 99)}",
    "addresses": lambda r: f"https://{r.choice(NAMES)}.example.com/{r.choice(NAMES)}/{r.choice(NAMES)}?{r.choice(NAMES)}={r.choice(NAMES)}&page={r.randint(1, 99)}",
}
AROUND = ["token path {} end\n", "the key: {}\n", "password reset at {} was done\n", "api_key_file = {}\n", "sha256 of the secret: sha256:{}\n"]


def draw(r, signs, n):
    return "".join(r.choice(signs) for _ in range(n))


@pytest.mark.parametrize("kind", KINDS)
def test_planted_secrets_are_found(kind):
    r, found = random.Random(kind), 0
    for k in range(200):
        word = KINDS[kind](r)
        text = CONTEXTS[k % 4].format(word)
        at = text.index(word)
        spans = [(s, e) for s, _, e in secret_scan.novel_spans(text, secret_scan.base_spans(text), 0.85, 256)]
        # A long run of key characters in a signed word is reported without what stands before its signs.
        found += any(min(e, at + len(word)) - max(s, at) >= 0.8 * len(word) for s, e in spans)
    assert found >= 190


def test_false_alarms_stay_below_one_percent():
    r, wrong, total = random.Random(8), 0, 0
    for kind, make in BENIGN.items():
        own = 0
        for k in range(300):
            text = AROUND[k % 4].format(make(r))
            own += bool(secret_scan.novel_spans(text, secret_scan.base_spans(text), 0.85, 256))
        assert own <= 9, kind
        wrong, total = wrong + own, total + 300
    assert wrong / total < 0.01
    for word in ("/usr/lib/x86_64-linux-gnu/libstdc++6", "2024-01-02T03-04-05Z_backup_000012", "123e4567-e89b-12d3-a456-426614174000"):
        for around in AROUND:
            assert not secret_scan.novel_spans(around.format(word), [], 0.85, 256)


def test_lines_bound_the_context():
    word = "Zk3vQ9xT1mB7cR5wL8nD2pHs"
    assert secret_scan.novel_spans("token " + "of the day " * 60 + word, [], 0.85, 256)
    assert not secret_scan.novel_spans("token\n" + word, [], 0.85, 256) and not secret_scan.novel_spans("token " + "of the day " * 120 + word, [], 0.85, 256)


def plain_novel(text):
    """Candidates one by one, each looking at its own line."""
    base = secret_scan.base_spans(text)
    runs = [(m.start(), m.end(), False) for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text)]
    runs += [(m.start(), m.end(), True) for m in re.finditer(r"[A-Za-z0-9!@#$%^&*~?+_.=/:-]{12,}", text) if set(m[0]) & set("!@#$%^&*~?") and not any(s < m.end() and m.start() < e for s, e, x in runs if not x)]
    out, near_ends = [], set()
    for s, e, signed in sorted(runs):
        line = text[max(text.rfind("\n", 0, s) + 1, 0) : s]
        words = [m.end() for m in re.finditer(r"(?i)auth|bearer|credential|passphrase|passwd|password|private|secret|signature|token|api[_-]?key|\bkey\b|\bpwd\b", line, re.A)]
        inside = any(a <= s < b for a, b in secret_scan.sensitive_blocks(text))
        near = inside or (text[s - 1 : s] == "." and s - 1 in near_ends) or bool(words) and len(line) - words[-1] <= 1024
        if not near:
            continue
        near_ends.add(e)
        word = text[s:e]
        if any(a < e and s < b for a, _, b in base) or not re.search("[A-Za-z]", word) or secret_scan._OTHER.fullmatch(word) or (not inside and secret_scan._CHECKSUM.search(text[max(0, s - 24) : s])):
            continue
        if signed and sum(bool(set(word) & set(a)) for a in (LOWER, LOWER.upper(), DIGITS)) < 2:
            continue
        if secret_scan.is_novel(word, secret_scan.novelty(word, text[max(0, s - 256) : s], text[e : e + 256]), 0.85, inside):
            out.append((s, 3, e))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_its_plain_twin(spark):
    from graphloom.llm import registry

    table = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.QUERIES["op8_secret_scan"](spark, SF).collect():
        got = [x for x in r.spans.split(",") if x.startswith("novel")]
        assert got == [f"novel:{s}:{e}" for s, _, e in plain_novel(table[r.doc_id])]
    mixed = " ".join(c.format(m(random.Random(k))) for k, (m, c) in enumerate(zip([*KINDS.values(), *BENIGN.values()], CONTEXTS * 5)))
    assert secret_scan.novel_spans(mixed, secret_scan.base_spans(mixed), 0.85, 256) == plain_novel(mixed) and plain_novel(mixed)
