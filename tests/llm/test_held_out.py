"""Held-out figures of the trained models, and the grouped part of the site quality against a plain version."""

import math
import random

import numpy as np
from testsieve.llm import licences as LI
from testsieve.llm import site_quality as Q

SF = "/root/testdata/sf0.1"


def test_quality_of_held_out_labels(spark):
    """Labels of a fifth of the labelled documents are kept from fit and score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "source as host", "'' as path")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    seen = labels.where("doc_id % 5 <> 0")
    hidden = {r.doc_id: r.quality for r in labels.where("doc_id % 5 = 0").collect()}
    rows = [r for r in Q.score(docs, seen, Q.fit(docs, seen)).collect() if r.doc_id in hidden]
    assert len(rows) > 200
    right = sum((r.score >= 0.5) == (hidden[r.doc_id] == 1) for r in rows) / len(rows)
    assert right >= 0.95, right


def test_sites_help_where_texts_say_little(spark):
    """Texts whose shape tells the class in two of three cases, on hosts that are mostly good or
    mostly bad: on held-out documents the score beats the document's own evidence."""
    rng = random.Random(8)
    rows, truth, labels = [], {}, []
    for i in range(4000):
        host = rng.randrange(200)
        good = rng.random() < (0.9 if host % 2 else 0.1)
        looks = good if rng.random() < 0.67 else not good
        text = ". ".join("word%d and more of it" % rng.randrange(99) for _ in range(8)) + "." if looks else "!!! ".join("BUY%d" % rng.randrange(9) for _ in range(20))
        rows.append((i, text, f"h{host}", f"p{rng.randrange(3)}"))
        truth[i] = good
        if i % 4:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = [r for r in Q.score(docs, known, Q.fit(docs, known)).collect() if r.doc_id % 4 == 0]
    share = lambda c: sum((r[c] >= 0.5) == truth[r.doc_id] for r in got) / len(got)
    loss = lambda c: -sum(math.log(r[c] if truth[r.doc_id] else 1 - r[c]) for r in got) / len(got)
    assert len(got) == 1000 and share("score") > share("p_doc") + 0.1 and loss("score") < loss("p_doc") - 0.1


def test_grouped_rates_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, "some words here. and more" if i % 2 else "BUY!!! NOW", rng.choice(["a", "b", None, "c"]), rng.choice(["x", "y", None])) for i in range(300)]
    labels = [(i, i % 2) for i in range(0, 300, 3)] + [(5, 0), (5, 1), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.score(docs, known, Q.fit(docs, known)).collect()}
    best = {}
    for i, y in labels:
        best[i] = max(best.get(i, 0), y)
    e = {i: float(best.get(i, got[i].p_doc)) for i in got}

    def groups(key):
        out = {}
        for i, _, host, path in rows:
            k = host if key == "host" else (host, path)
            n, s = out.get(k, (0, 0.0))
            out[k] = (n + 1, s + e[i])
        return out

    rate = sum(e.values()) / len(e)

    def strength(g):
        v = [(n, s) for n, s in g.values() if n >= 2]
        n, q = sum(x for x, _ in v), sum(x * (s / x - rate) ** 2 for x, s in v)
        if not v or n <= len(v):
            return Q.STRENGTH[1]
        noise = rate * (1 - rate)
        return min(Q.STRENGTH[1], max(Q.STRENGTH[0], noise / max(1e-9, (q - len(v) * noise) / n) - 1))

    hosts, paths = groups("host"), groups("path")
    kh, kp = strength(hosts), strength(paths)
    clip = lambda p: min(1 - 1e-4, max(1e-4, p))
    for i, _, host, path in rows:
        hn, hs = hosts[host]
        pn, ps = paths[host, path]
        h = clip((hs - e[i] + kh * rate) / (hn - 1 + kh))
        p = clip((ps - e[i] + kp * h) / (pn - 1 + kp))
        odds = math.log(got[i].p_doc / (1 - got[i].p_doc)) + Q.SITE_WEIGHT * (math.log(p / (1 - p)) - math.log(rate / (1 - rate)))
        assert abs(got[i].host_rate - h) < 1e-9 and abs(got[i].path_rate - p) < 1e-9 and abs(got[i].score - 1 / (1 + math.exp(-odds))) < 1e-9


def test_licences_in_changed_notices(spark):
    """Recall on notices that the fit has not seen in this form: other words around, wrapped at
    random widths, in capitals, with a word changed; and no family in texts of licence words."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ra", "lo", "mi", "ten", "sub") for b in ("ver", "na", "dis", "op")] + ["the", "of", "and", "public", "software", "free", "license"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for family, notices in LI.TEMPLATES.items():
        for notice in notices:
            for form in ("around", "wrapped", "capitals", "changed"):
                for _ in range(3):
                    w = notice.split()
                    if form == "changed":
                        if len(w) < 12:
                            continue
                        k = rng.choice([i for i, x in enumerate(w) if not any(c.isdigit() for c in x)])
                        w[k] = "changed"
                    text = " ".join(w)
                    if form == "capitals":
                        text = text.upper()
                    elif form == "wrapped":
                        width, lines = rng.randint(3, 9), []
                        for i in range(0, len(w), width):
                            lines.append(" ".join(w[i:i + width]))
                        text = "\n".join(lines)
                    text = f"{some(rng.randint(0, 12))} {text} {some(rng.randint(0, 12))}" if form != "wrapped" else f"{some(9)}\n{text}\n{some(9)}"
                    want[len(rows)] = (family, form)
                    rows.append((len(rows), text))
    clean = [(100_000 + i, "\n".join(some(rng.randint(1, 30)) for _ in range(4))) for i in range(1500)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {r.doc_id: r for r in LI.scan(docs, LI.fit(docs.where("doc_id >= 100000"))).collect()}
    hits = {}
    for i, (family, form) in want.items():
        hits.setdefault(form, []).append(family in got[i].families.split(","))
    recall = {form: float(np.mean(x)) for form, x in hits.items()}
    missed = [(f, m, got[i].families, rows[i][1]) for i, (f, m) in want.items() if f not in got[i].families.split(",")]
    assert all(r >= 0.95 for r in recall.values()), (recall, missed)
    assert not any(got[i].families for i, _ in clean)
