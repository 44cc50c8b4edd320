"""Fill-in-middle: the checkpoint index, the forms, and the whole result against plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import infill


@settings(max_examples=200, deadline=None)
@given(
    st.text(st.sampled_from("ab\n\n\ré日🙂<P>"), max_size=60), st.sampled_from(["line", "char"]),
    st.integers(1, 5), st.integers(1, 9),
)
def test_index(text, unit, step, block):
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    index = infill.Checkpoints(text.encode(), unit, step, block)
    assert (index.n, index.n_chars) == (len(units), len(text))
    assert list(index.units) == list(range(0, max(len(index.units), 1) * step, step))
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert index.cut(k) == (len(before.encode()), len(before))


def test_index_stays_sparse():
    index = infill.Checkpoints(b"a line\n" * 100_000)
    assert index.n == 100_000 and len(index.units) == 100_000 // infill.STEP + 1
    assert index.cut(77_777) == (7 * 77_777, 7 * 77_777)


def test_unknown_unit():
    with pytest.raises(ValueError):
        infill.Checkpoints(b"", "word")


def plain(doc_id, text, plan):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if plan.unit == "line" else list(text)
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if text == "" or any(x in text for x in infill.SENTINELS) or h3 % 100 >= plan.percent:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < plan.spm_percent:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    [700, "\n", "en", "s"], [701, "\n\n\n", "en", "s"], [702, "no line end", "en", "s"], [703, "a <S> inside\nof it", "en", "s"],
    [704, "<M>", "en", "s"], [705, "<<P\n<S\n<<M\n>", "en", "s"], [706, "a\r\nb\rc d\n", "en", "s"], [707, "日本\n語🙂\n" * 9000, "en", "s"],
    [708, "<P", "en", "s"], [708, "<P", "en", "s"],
]


@pytest.mark.parametrize("plan", [infill.Plan(), infill.Plan(seed=3, unit="char", percent=60, spm_percent=20, step=5, block=64)])
def test_result(frame, rows, plan):
    rows = rows + ODD
    got = infill.fill_in_middle(frame(rows), plan)
    want = [plain(i, t, plan) for i, t, _, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digest = sorted((r.doc_id is None, r.doc_id or 0, r.output_sha256, r.restored_sha256) for r in infill.digests(got).collect())
    assert digest == sorted((w[0] is None, w[0] or 0, sha(w[5]), sha(t or "")) for w, (_, t, _, _) in zip(want, rows, strict=True))


def test_empty(empty):
    out = infill.digests(infill.fill_in_middle(empty))
    assert out.count() == 0 and out.columns[-1] == "restored_sha256"
