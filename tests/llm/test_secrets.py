import base64
import hashlib
import random

import pytest

from graphloom.llm import secrets

from .helpers import docs


@pytest.mark.parametrize("n", [16, 32, 40, 64, 96, 128, 256, 1000, 4000])
def test_random_keys_are_found_at_every_length(n):
    r = random.Random(n)
    for _ in range(5):
        for value in (r.randbytes(n).hex()[:n], r.randbytes(n).hex()[:n].upper(), base64.b64encode(r.randbytes(n)).decode()[:n]):
            assert [(f[0], f[1]) for f in secrets.scan_text(f'secret = "{value}"')] == [(10, n)]
    assert secrets.scan_text("token = " + "deadbeef" * (n // 8)) == [] or n == 16


KEY = base64.b64encode(random.Random(7).randbytes(30)).decode()
BODY = base64.b64encode(random.Random(8).randbytes(300)).decode()
FAR = "x" * 5 + " word" * 40


@pytest.mark.parametrize(
    "text, values",
    [
        (f"token:\n  {KEY}", [KEY]),
        (f'{{"a": 1,\n"token":\n\n"{KEY}"}}', [KEY]),
        (f"secrets:\n  db:\n    - name: x\n      value: {KEY}\nother:\n  value: {BODY[:40]}", [KEY]),
        (f"api_key = \\\n  {KEY}", [KEY]),
        (f"password {FAR} {KEY}", [KEY]),
        (f'{{"value":"{KEY}","pad":"{FAR}","name":"api_key"}}', [KEY]),
        ('password = "Tr0ub4d&"', ["Tr0ub4d&"]),
        ("'passwd': 'a!b@c#d$e%f&g*h(i)jkl'", ["a!b@c#d$e%f&g*h(i)jkl"]),
        ('set("token", "password", "p4$$w0rd!")', ["p4$$w0rd!"]),
        ('"{\\"password\\": \\"S3cr3t!x\\"}"', ["S3cr3t!x"]),
        ('password: str = "S3cr3t!x"', ["S3cr3t!x"]),
        ('password = "${PASSWORD}" token="<your-token>" secret="********" pwd="settings" author="J.R.Smith2"', []),
        (f"token\n{KEY}", []),
        (f"class Token:\n    commit = {KEY}", []),
        (f"-----BEGIN PUBLIC KEY-----\n{BODY}\n-----END PUBLIC KEY-----", []),
        ("starts with -----BEGIN PRIVATE KEY----- and then some words follow until -----END PRIVATE KEY-----", []),
    ],
)
def test_context(text, values):
    assert [text[f[0] : f[0] + f[1]] for f in secrets.scan_text(text)] == values


@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", '\\n"\n  "'])
@pytest.mark.parametrize("tail", ["-----END RSA PRIVATE KEY-----\n", ""])
def test_private_keys_are_whole(end, tail):
    text = "x = -----BEGIN RSA PRIVATE KEY-----" + end + "".join(BODY[i : i + 64] + end for i in range(0, len(BODY), 64)) + tail
    (f,) = secrets.scan_text(text)
    assert (f[0], f[0] + f[1], f[2]) == (text.index(BODY[:64]), text.rindex(BODY[-16:]) + 16, "private key") and f[5] == hashlib.sha256(BODY.encode()).hexdigest()


def test_private_keys_leave_the_jvm(spark):
    text = f"-----BEGIN EC PRIVATE KEY-----\n{BODY}\n-----END EC PRIVATE KEY-----"
    assert [r["context"] for r in secrets.secret_findings(docs(spark, [(1, text, "en", "s")])).collect()] == ["private key"]


def test_whole_table_against_brute_force(spark, sf_dir):
    import hashlib
    import re

    d = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = sorted((r["doc_id"], r["start"], r["length"], r["sha256"]) for r in secrets.secret_findings(d).collect())
    assert got == sorted((i, a, n, sha) for i, t in rows for a, n, _, _, _, sha, _ in secrets.scan_text(t))  # none is lost before a text leaves the JVM
    assigned = re.compile(r"(?i)(?:token|secret|password|api_key|key)\w*\s*[=:]\s*[\"']([0-9a-f]{32,})[\"']")
    planted = {(i, m.start(1), hashlib.sha256(m[1].encode()).hexdigest()) for i, t in rows for m in assigned.finditer(t)}
    assert planted and planted <= {(i, a, sha) for i, a, _, sha in got}
