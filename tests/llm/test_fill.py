import hashlib
import re

import pytest

from colloquy.llm.fill_in_middle import fill_in_middle, fill_in_middle_digests, restore

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plainly(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"{seed}:{'' if i is None else i}")[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["", None, "\n", "\n\n", "a", "a\n", "a\nb", "<\n<P\n<S>\n", "<\n<\nP>\nS>\n<", "P>\n<M\nM>\n", "a\0b\nc\0", "é́🙂\n日本\r\n\r", " x\x85y\n", "x" * 300_000 + "\n" + "y\n" * 50_000]


@pytest.mark.parametrize("rate", [100, 30, 0])
def test_equals_brute_force(spark, docs_frame, rate):
    rows = [(k, t) for k, t in enumerate(ODD * 6)] + [(None, "a\nb\nc")] + list(zip(docs_frame.doc_id.tolist(), docs_frame.text.tolist(), strict=True))
    df = spark.createDataFrame([(None if i is None else int(i), t) for i, t in rows], "doc_id long, text string").coalesce(2)
    got = sorted(map(repr, fill_in_middle(df, rate=rate).drop("text").collect()))
    want = sorted(f"Row(doc_id={i!r}, n={n}, form={f!r}, prefix_chars={p}, middle_chars={m}, output={o!r})" for i, t in rows for n, f, p, m, o in [plainly(i, t, rate)])
    assert got == want
    digests = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars or 0, r.output_sha256, r.restored_sha256) for r in fill_in_middle_digests(df, rate=rate).collect())
    assert digests == sorted((str(i), n, f, p or 0, sha(o), sha(t or "")) for i, t in rows for n, f, p, m, o in [plainly(i, t, rate)])


def test_restores_and_keeps_clashing_columns(spark, edges, empty, edge_frame):
    wide = edges.withColumnsRenamed({"id": "form", "x": "output", "row": "restored"})
    made = fill_in_middle(wide)
    assert made.columns == [*wide.columns, "_n", "_form", "prefix_chars", "middle_chars", "_output"]
    back = restore(made, "_output", "_form")
    assert sorted(str((r.doc_id, r._restored)) for r in back.collect()) == sorted(str((r.doc_id, r.text or "")) for r in edges.collect())
    assert {(r.form, r.output, bytes(r.restored)) for r in back.collect()} == {(7, "c", b"z")}
    assert fill_in_middle(empty).count() == 0 and fill_in_middle_digests(empty).count() == 0
    assert restore(spark.createDataFrame([(None, None)], "output string, form string")).first().restored is None
