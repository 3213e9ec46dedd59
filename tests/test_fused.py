import math

from fieldsift.operators import evaluation

SCHEMA = "fileId string, itemKey string, true string, proba array<double>"
CLASSES = ["a", "b", "c"]


def brute(rows):
    rows = [r for r in rows if r[3] is not None and r[2] is not None]
    logs = {r[0]: [math.log(min(max(p, 1e-9), 1.0)) for p in r[3]] for r in rows}
    out = {}
    for kind in ("single", "fused"):
        pairs = []
        for f, k, t, p in rows:
            own, rest = logs[f], [logs[r[0]] for r in rows if r[1] == k and r[0] != f] if k else []
            score = p if kind == "single" else [o + sum(x[i] for x in rest) / len(rest) if rest else o for i, o in enumerate(own)]
            pairs.append((t, CLASSES[max(range(3), key=lambda i: (score[i], -i))]))
        f1 = [2 * sum(t == g == c for t, g in pairs) / (sum(t == c for t, _ in pairs) + sum(g == c for _, g in pairs)) for c in {t for t, _ in pairs}]
        out[kind] = (round(sum(t == g for t, g in pairs) / len(pairs), 9), round(sum(f1) / len(f1), 9), len(pairs))
    return out


def test_both_marks(spark):
    rows = [
        ("1", "i", "a", [0.4, 0.5, 0.1]), ("2", "i", "a", [0.9, 0.05, 0.05]), ("3", "j", "b", [0.2, 0.7, 0.1]), ("4", "j", "b", [0.5, 0.4, 0.1]),
        ("5", "", "c", [0.1, 0.5, 0.4]), ("6", "", "a", [1.0, 0.0, 0.0]), ("7", None, "c", [0.0, 0.0, 1.0]), ("8", "i", "a", None), ("9", "j", None, [0.0, 1.0, 0.0]),
    ]
    got = {r.kind: (round(r.top1, 9), round(r.macroF1, 9), r.support) for r in evaluation.fused_and_single(spark.createDataFrame(rows, SCHEMA), CLASSES).collect()}
    assert got == brute(rows) and got["fused"][0] > got["single"][0]
    assert evaluation.fused_and_single(spark.createDataFrame([], SCHEMA), CLASSES).collect() == []
