"""Operators on pairs, groups and joins, against brute force."""

import json

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import chat, components, queries, simhash, topk, urlfilter

# SimHash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t\n", "One", "ONE", "a b c", "a b c d", "a b c d e a b c d e", "É\u00a0x É y", "w " * 3000, "x" * 500] + ["the cat sat on a mat and " * 3 + f"n{i}" for i in range(5)]


def brute_components(ids, prints):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    out = {}
    for i, d in enumerate(ids):
        out.setdefault(label[i], []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in out.items()}
    return [least[x] for x in label]


def test_fingerprints():
    assert [simhash.fingerprint(t) for t in TEXTS] == [brute_fingerprint(t) for t in TEXTS]


def test_xxhash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("añb"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("añb".encode(), 42)


def test_deduplicate(spark):
    docs = [(i, t, "x", 1) for i, t in enumerate(TEXTS, 10)] + [(10, TEXTS[0], "y", 2), (None, TEXTS[-1], "z", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fingerprint string, simhash int")
    rows = simhash.deduplicate(df).collect()
    prints = [brute_fingerprint(d[1]) for d in docs]
    want = sorted((str(d[0]), f"{p:016x}", c) for d, p, c in zip(docs, prints, brute_components([d[0] for d in docs], prints), strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == want
    kept = sorted(str(r["doc_id"]) for r in simhash.keep_first(df).collect())
    assert kept == sorted({str(c) for _, _, c in want} | {"None"})
    assert simhash.deduplicate(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_no_link_is_lost(spark, block):
    rng = np.random.default_rng(1)
    prints = [int(x) for x in rng.integers(0, 2**63, 80, dtype=np.uint64)]
    for base in prints[:25]:
        for _ in range(8):
            x = base
            for p in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(p)
            prints.append(x)
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "simhash long")
    root = {r["node"]: r["root"] for r in components.components(simhash.link_fingerprints(df, block=block)).collect()}
    assert [root.get(x, x) for x in signed] == brute_components(signed, prints)


def test_pigeonring_keeps_all_within_four_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for p in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(p)
    found = np.zeros(len(x), dtype=bool)
    for start in range(5):
        found |= simhash.chains_hold(x, y, np.full(len(x), start))
    assert found.all()


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 3), (5, 5), (None, 7), (8, 9), (9, 10), (10, 11), (11, 12), (8, 12)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} | dict.fromkeys((8, 9, 10, 11, 12), 8) | dict.fromkeys(range(100, 141), 100)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Top-k


def brute_top(rows, k):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in usable:
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i is None, i or 0) for i, y in usable if i != q)
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows_a_block, queries_a_block, dropped", [(1 << 16, 64, 3), (7, 2, 3), (64, 3, 0), (40, 64, 6)])
def test_top_k(spark, rows_a_block, queries_a_block, dropped):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.3, 5), 2)]) for i in range(0, 260)]
    rows += [(7, rows[7][1]), (1000, rows[3][1]), (1050, None), (1100, []), (1150, [1.0, None]), (1200, [float("nan")]), (1250, [float("inf")]), (None, rows[0][1]), (1300, [0.5, -0.25]), (1350, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = topk.search(df, F.col("vec_id") % 50 == 0, row_block=rows_a_block, query_block=queries_a_block, dropped=dropped).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 5)


@pytest.mark.parametrize("least, most", [(1e-3, 1e3), (1e-3, 1e6), (1e5, 1e7)])
def test_top_k_of_large_components(spark, least, most):
    rng = np.random.default_rng(4)
    rows = [(i, [float(s * 10**e) for s, e in zip(rng.choice([-1, 1], 4), rng.uniform(np.log10(least), np.log10(most), 4), strict=True)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()) == brute_top(rows, 5)


def test_top_k_never_wraps(spark):
    rows = [(0, [1.0]), (1, [1e7]), (2, [2e7]), (3, [9e6]), (50, [1e-3]), (4, [1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [4, 2, 1, 3, 50]
    wide = spark.createDataFrame([(0, [4e12] * 64), (1, [4e12] * 64), (2, [-4e12] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit in a long"):
        topk.search(wide, F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="beyond"):
        topk.search(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_top_k_exact_beyond_64_bits():
    """The bound passes 2**63, the scores don't: they cancel."""
    values = np.array([[1 << 45, 1 << 45], [(1 << 45) + 1, 1 << 45], [1 << 45, (1 << 45) + 3]], dtype=np.int64)
    rows, scores = topk.Block(np.arange(3), values).top(np.array([1 << 30, -(1 << 30)]), 9, 3)
    assert rows.tolist() == [1, 0, 2] and scores.tolist() == [1 << 30, 0, -3 << 30]


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.search(df, F.col("vec_id") == 9).count() == 0
    assert topk.search(df.where("false"), F.col("vec_id") == 0).count() == 0


# URL filter


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        for c in "?#":
            path = path.split(c, 1)[0]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if url is not None and "://" in url and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTPS://WWW.Example.ORG/es/x", "http://example.org/en/12?q=/es/", "http://a.b.example.org/en/2#f", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/DE/", "http://x.com?de/", "http://com/de/", "http://a..org/x", "http://.org/", "http://x.org:80/", "a://b://c.com/fr/", "http://É.com/de/ü", "http://x.com/de/" + "a/" * 500, "http://" + "a." * 300 + "com/fr/"]


@pytest.mark.parametrize("limit", [urlfilter.BROADCAST_RULES, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    rows = [(i, u, "r") for i, u in enumerate(URLS)] + [(6, URLS[6], "r"), (None, URLS[11], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in urlfilter.judge(df, queries.URL_RULES).collect())
    want = sorted((str(i), h, p, str(r), v) for i, u, _ in rows for h, p, r, v in [brute_judge(u, queries.URL_RULES)])
    assert got == want
    assert urlfilter.judge(df.where("false"), queries.URL_RULES).count() == 0


def test_url_rules(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert urlfilter.judge(df, []).first()["verdict"] == "allow"
    assert urlfilter.judge(df, [("allow", "net", ""), ("block", "net", "")]).first()["verdict"] == "block"
    with pytest.raises(ValueError):
        urlfilter.judge(df, [("deny", "net", "")])


# Chat

SCHEMAS = {"add": {"a": {"type": "integer", "required": True, "minimum": 0}, "b": {"type": "number", "required": True}, "how": {"type": "string", "enum": ["x", "y"]}}}


def transcript(spark, calls_by_turn, answers):
    rows = [(1, t, "assistant", json.dumps({"tool_calls": calls}), "extra") for t, calls in calls_by_turn] + [(1, t, "tool", json.dumps({"tool_call_id": i, "content": c}), "extra") for t, i, c in answers]
    return spark.createDataFrame([*rows, (1, 0, "user", "hello", None), (2, 0, "assistant", "plain text", None), (2, 1, "tool", None, None)], "conv_id long, turn long, role string, text string, status string")


def call(i, args, after=()):
    return {"id": i, "name": "add", "arguments": json.dumps(args), "after": list(after)}


def test_tool_calls(spark):
    messages = transcript(
        spark,
        [(1, [call("p", {"b": 1, "a": 2}), call("q", {"a": -1, "b": "x", "z": 0}, ["p"])]), (3, [call("p", {"a": 9, "b": 9}), call("r", [1], ["nowhere"])])],
        [(2, "p", "3"), (4, "p", "later"), (5, "ghost", "é")],
    )
    rows = {(r["conv_id"], r["call_id"]): r for r in chat.link(*chat.from_tool_messages(messages), SCHEMAS).collect()}
    p = rows[1, "p"]
    assert (p["status"], p["valid"], p["copies"], p["result_turn"], p["topo_level"]) == ("linked", True, 2, 2, 0)
    assert p["message"] == '{"call":{"arguments":{"a":2,"b":1},"id":"p","name":"add","turn":1},"result":{"content":"3","id":"p","turn":2}}'
    assert rows[1, "q"]["errors"] == ["a: below 0", "b: not of type number", "z: unknown"] and rows[1, "q"]["status"] == "no_result"
    assert rows[1, "r"]["errors"] == ["arguments are not an object", "waits for an absent call"]
    ghost = rows[1, "ghost"]
    assert (ghost["status"], ghost["valid"], ghost["message"]) == ("no_call", False, '{"result":{"content":"é","id":"ghost","turn":5}}')


def test_topological_order(spark):
    good = {"a": 1, "b": 1}
    messages = transcript(spark, [(1, [call("a", good, ["b"]), call("b", good, ["c"]), call("c", good), call("x", good, ["y"]), call("y", good, ["x"]), call("z", good, ["y", "c"])])], [])
    rows = {r["call_id"]: r for r in chat.link(*chat.from_tool_messages(messages), SCHEMAS).collect() if r["conv_id"] == 1}
    assert {k: r["topo_level"] for k, r in rows.items()} == {"c": 0, "b": 1, "a": 2, "x": None, "y": None, "z": None}
    assert rows["x"]["errors"] == ["waits for itself"] and rows["a"]["valid"]


def test_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", ""), (1, 5, "user", None), (1, 9, "assistant", "lost"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (2, None, "user", "u"), (2, 0, None, "r"), (1, 1, "user", "q")]
    out = chat.link(*chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.TURN_SCHEMAS)
    got = {(r["conv_id"], r["call_id"]): r for r in out.collect()}
    assert got[1, "1:1"]["status"] == "linked" and got[1, "1:1"]["copies"] == 2 and got[1, "1:1"]["valid"]
    assert got[1, "1:3"]["errors"] == ["text: shorter than 1"]
    assert got[1, "1:5"]["errors"] == ["text: not of type string"]
    assert got[1, "1:8"]["status"] == "no_call" and got[None, "null:0"]["status"] == "linked"
    assert got[2, None]["status"] == "no_result" and got[2, "2:0"]["errors"] == ["unknown name"]
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link(*chat.from_turns(nothing), chat.TURN_SCHEMAS).count() == 0
