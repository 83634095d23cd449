import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import zlib

import zstandard

from sievemark.llm import secrets


def spans(text):
    base, more, _ = secrets.scan(text.encode())
    return secrets.in_code_points(text.encode(), sorted(base + more))


def test_base_spans_match_a_plain_scan(spark):
    texts = [None, "", "é token: 'abcdef123' x", "passwd=abc", "secret=secret=abcdef", "AKIA" + "A" * 16, "AKIAA",
             "f" * 23, "f" * 24 + "G" + "0" * 40, "Api_Key := zzzzzzzz", "token==abcdefg\ntoken =\n abcdefg"] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hex string")
    got = {r.doc_id: r for r in secrets.scan_documents(df).collect()}
    flags = re.ASCII | re.IGNORECASE
    for i, t in enumerate(texts):
        t, want = t or "", []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, flags):
            want += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(want))
        assert got[i].base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
    assert secrets.scan_documents(df.limit(0)).count() == 0


def test_nested_layers_map_back():
    inner = "password=hunter2hunter2"
    b64 = base64.b64encode(inner.encode()).decode()
    assert spans(f"x {b64} y") == [f"assign:2:{2 + (len(inner) * 8 + 5) // 6}"]
    zipped = base64.b64encode(gzip.compress(inner.encode())).decode()
    assert f"assign:3:{3 + len(zipped)}" in spans(f"é: {zipped}")
    twice = base64.b64encode(b64.encode()).decode()
    assert len(spans(twice)) == 1
    assert spans(f"{twice} {twice}")[1].startswith(f"assign:{len(twice) + 1}:")
    assert spans("a token%3Dabcdef99 b") == ["assign:2:18"]
    assert spans("token" + chr(92) + "u003dabcdef99") == ["assign:0:19"]
    assert spans("%25" * 4 + "token%253Dabcdef99") != []


def test_cycles_end():
    assert secrets.scan(b"%2525252525")[2] == 5
    assert secrets.scan(b"A" * 100_000)[2] == 0


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    assert secrets.scan(b"a%41 " + b"x" * 2_000_000)[2] == 1
    assert secrets.scan(b"\\u0041 " + b"x;" * 1_000_000)[2] == 1
    assert time.perf_counter() - began < 60


def test_whole_layers():
    inner = b"password=hunter2hunter2"
    b64 = lambda x: base64.b64encode(x).decode()
    gz = gzip.compress(inner)
    noise = bytes(range(256)) * 40
    assert spans(f"x {b64(gzip.compress(gz))} y") != [] and spans(b64(zlib.compress(zlib.compress(inner)))) != []
    assert spans("data=" + "".join(f"%{x:02X}" for x in gz)) != [] and spans("".join(f"%{x:02x}" for x in zlib.compress(inner))) != []
    assert spans("".join(f"{chr(92)}x{x:02x}" for x in gz)) != []
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        assert spans(b64(pack(b"nothing here") + pack(inner))) != []
        assert secrets.scan(b64(pack(b"a" * 5000 + inner + b"b" * 5000)).encode(), 1000)[1] != []
    cut = gzip.compress(inner + b" " + noise)
    assert spans(b64(cut[:-9])) != [] and spans(b64(cut[:-9] + b"broken" * 9)) != []
    assert spans(b64(b"\0\xff" + inner + b"\x01")) != []
    for packed in (b"some long text before it, well over a line of seventy-six columns " + inner, gzip.compress(noise + inner)):
        for end in ("\n", "\r\n"):
            lines = base64.encodebytes(packed).decode().replace("\n", end)
            assert spans("word" + end + lines) != [] and spans("words:" + end + lines + " more") != [] and spans("a word" + end + "b" + end + lines) != []
    text = "x " + base64.encodebytes(b"-" * 50 + inner + b" and more").decode()
    assert [f"assign:{2 + 50 * 8 // 6}:{2 + 1 + (73 * 8 + 5) // 6}"] == spans(text)
    assert spans("token%3D \"abcdef99\" b") == ["assign:0:18"]


def test_rewritten_spans():
    new, spread = secrets.rewritten(b"a%41%42b", secrets.ESCAPE, lambda x: bytes([int(x[1], 16)]))
    assert new == b"aABb" and [spread(i, i + 1) for i in range(4)] == [(0, 1), (1, 4), (4, 7), (7, 8)]
    assert spread(0, 4) == (0, 8) and spread(1, 3) == (1, 7)


def test_base64_behind_letters_of_its_alphabet():
    import base64
    import gzip

    from sievemark.llm import secrets

    for body in (b"password=hunter2hunter2", gzip.compress(b"say password=hunter2hunter2 now", mtime=0)):
        inner = base64.b64encode(body).rstrip(b"=")
        for before in (b"", b"data/", b"/", b"blob-", b"key_", b"https://ex.com/", b"a", b"ab", b"abc"):
            text = b"see " + before + inner + b" and more"
            base, more, _ = secrets.scan(text)
            start = text.index(inner)
            assert not base
            assert any(k == 0 and start <= s < e <= start + len(inner) for s, k, e in more), (before, body[:2])
