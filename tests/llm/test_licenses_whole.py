"""Licence findings against a version by brute force, and statements wrapped over lines."""

import math
import textwrap

import numpy as np
import pyarrow as pa

from tests.llm.edges import docs, prose
from tritsift.llm import licenses
from tritsift.llm import text as tx


def brute(text, m):
    """{(line, family)} of one text: every line, then every part of lines, by plain words and loops."""
    p, lines = m.params, [tx.plain_words(x) for x in (text or "").split("\n")]
    grams = lambda ws: {tuple(ws[i : i + 2]) for i in range(max(1, len(ws) - 1))} if ws else set()
    forms = [[grams(tx.plain_words(t)) for t in family] for family in licenses.TEMPLATES.values()]

    def judge(ws):
        h = tx.hash_words(ws)
        z = m.bias.copy()
        feats = [int(tx.mix(np.array([g + np.uint64(n)]))[0] >> np.uint64(64 - p.bits)) for n in range(1, p.max_n + 1) for g in tx.ngrams(h, np.array([0, len(h)]), n)[0]]
        z = (z + sum(m.weights[f].astype(float) for f in feats) / math.sqrt(len(feats))) / m.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    share = lambda f, ws: max(len(t & grams(ws)) / len(t) for t in forms[f])
    out = set()
    for n, ws in enumerate(lines):
        if ws:
            x = judge(ws)
            f = int(x[:-1].argmax())
            if x[f] >= p.threshold and share(f, ws) >= p.confirm:
                out.add((n, f))
    taken, parts = set(out), []
    for f, family in enumerate(forms):
        for a in range(len(lines)):
            for b in range(a + 1, min(len(lines), a + p.max_lines)):
                if all(lines[a : b + 1]):
                    enough = lambda x, y: any(len(t & grams([w for k in lines[x : y + 1] for w in k])) >= math.ceil(p.confirm * len(t) - 1e-9) and t is u for t in family)  # noqa: B023, E731
                    for u in family:
                        # Pairs over the border of a part's first line count for that line.
                        if enough(a, b) and not enough(a + 1, b) and not enough(a, b - 1):
                            parts.append((f, a, b))
    sure = []
    for f, a, b in sorted(set(parts)):
        ws = [w for k in lines[a : b + 1] for w in k]
        x = judge(ws)
        if x[:-1].argmax() == f and x[f] >= p.threshold:
            sure.append((-share(f, ws), -x[f], b - a, a, b, f))
    for s, _, _, a, b, f in sorted(sure):
        if -s >= p.confirm and not {(n, f) for n in range(a, b + 1)} & taken:
            taken |= {(n, f) for n in range(a, b + 1)}
            out.add((a, f))
    return {(n, m.families[f]) for n, f in out}


def model(spark):
    noise = [(d, "\n".join(prose(d * 10 + n, 15) for n in range(5))) for d in range(40)]
    return licenses.train(docs(spark, noise), licenses.LicenseParams(max_unknown=200))


def test_wrapped_statements(spark):
    m = model(spark)
    forms = {f: max(t, key=len) for f, t in licenses.TEMPLATES.items()}
    for width in (60, 72):
        for mark in ("", "# ", " * "):
            for f in ("gpl", "lgpl", "bsd", "mit", "apache"):
                body = "\n".join(mark + x for x in textwrap.wrap(forms[f], width))
                text = f"{prose(3, 9)}\n\n{body}\n\n{prose(4, 9)}"
                found = licenses.findings(pa.array([text]), m)
                assert {x[2] for x in found} == {f} and found[0][0] == 0 and 2 <= found[0][1] <= 4, (f, width, found)
    apart = "\n\n".join(textwrap.wrap(forms["gpl"], 60))  # blank lines part paragraphs
    assert not licenses.findings(pa.array([apart]), m)


def test_findings_against_brute_force(spark):
    m = model(spark)
    forms = [t for family in licenses.TEMPLATES.values() for t in family]
    texts = [None, "", "\n\n", *licenses.NEAR_MISSES[:4]]
    for i, t in enumerate(forms[::2]):
        texts.append(f"{prose(i, 8)}\n{t}\n{prose(i + 90, 8)}")
        if len(t) > 60:
            texts.append("\n".join((prose(i, 8), *textwrap.wrap(t, 50), prose(i + 1, 5))))
    got = {}
    for r, n, f, _, _ in licenses.findings(pa.array(texts), m):
        got.setdefault(r, set()).add((n, f))
    assert sum(map(len, got.values())) > 20
    for r, t in enumerate(texts):
        assert got.get(r, set()) == brute(t, m), (r, t)
