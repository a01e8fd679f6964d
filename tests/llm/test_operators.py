"""Each operator against a brute-force version on small fixtures, with nulls, empty and long texts, repeats and clashes."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_fixtures import ODD, SCHEMA, docs_of, lower

from spindrift.llm import automaton, base, decontamination, pii, quality_gam, quality_rules, secret_scan, sharding, simhash, toxicity, url_filters

def test_quality_measurements(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c#", "\n", "\u00a0", "d|", " "]) for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in quality_rules.ledger(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        c = Counter(wins)
        covered = {p for k, w in enumerate(wins) if c[w] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i])[1:6] == want, t
    ledger = quality_rules.ledger(docs_of(spark, texts))
    rows = ledger.collect()
    for r in quality_rules.ablation(ledger, 2).collect():
        bit = next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        mask = quality_rules.mask_of(quality_rules.POLICIES[2])
        assert r.n_kept_without == sum((x.failed_bits & mask & ~(1 << bit)) == 0 for x in rows)


def test_url_rules(spark):
    longer = (("allow", "a.example.com", "/"), ("block", "example.com", "/en/private/"), ("block", "com", "/en/private/x"), ("allow", "b.com", "/en"), ("block", "com", "/b/en"))
    trie = url_filters.Trie(longer)
    assert trie.match("a.example.com", "/en/private/x").rule == "example.com/en/private/"
    assert trie.match("a.example.com", "/en/priv").rule == "a.example.com/" and trie.match("c.com", "/en/private/xy").verdict == "block"
    assert trie.match("b.com", "/b/en") and trie.match("example.com", "/fr/") is None
    cases = {
        "https://www.example.com/en/1": "www.example.com/en/", "http://x.example.com/en/": "example.com/en/", "http://EXAMPLE.com/en/?q": "example.com/en/", "http://x.com/a": "com/", "http://x.com": None,
        "http://a.net/es/1": "net/es/", "http://a.net/esx/": None, "http://net/fr/": "net/fr/", "no scheme": None, None: None, "http://notexample.com/en/1": "com/", "http://x.org/en/": None, "a://b://c.com/d": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id int, url string")
    got = {r.page_id: r for r in url_filters.judge(rows).collect()}
    for i, (url, rule) in enumerate(cases.items()):
        assert got[i].rule == rule, url
        assert got[i].verdict == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")


def test_automaton_finds_where_rules_match():
    rules = ["ab+c", "(?i:x[0-9]{2,3})", "q(r|s)?t"]
    auto = automaton.compile_rules(rules)
    rng = random.Random(2)
    for _ in range(200):
        data = "".join(rng.choice("abcxX019qrst\n") for _ in range(rng.randrange(0, 400))).encode()
        want = []
        for end in range(1, len(data) + 1):
            bits = sum(1 << k for k, r in enumerate(rules) if re.search(rf"(?:{r})\Z".encode(), data[:end]))
            if bits:
                want.append((end - 1, bits))
        at, bits = auto.accepted(data)
        assert list(zip(at.tolist(), bits.tolist())) == want


def contract_secrets(text):
    """The base spans, by the contract's own patterns."""
    fold = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    key = "|".join(map(fold, ("password", "passwd", "secret", "token"))) + f"|{fold('api')}_?{fold('key')}"
    patterns = (("assign", rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, group, size) in enumerate(patterns) for m in re.finditer(p, text or "") if len(m.group(group)) >= size]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_secrets_match_the_contracts_patterns(spark):
    rng = random.Random(3)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "passwd", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f", "é", "\n", "./+", "ghp_", "eyJa", "ſ", "token=token:"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 50))) for _ in range(3000)] + ["eyJa " * 20000]
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.found] for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[2] in secret_scan.BASE_KINDS] == contract_secrets(t), t
    assert got[len(texts) - 1] == []
    assert secret_scan.scan(docs_of(spark, texts).limit(0)).collect() == []


def test_the_methods_own_secrets():
    run = "a1B2" * 12
    cases = {
        f"x ghp_{run} y": [("github", 2, 2 + 4 + 48)], "ghp_short": [], f"xoxb-{run[:10]}-9": [("slack", 0, 17)], "xoxb-a": [], "-----BEGIN RSA PRIVATE KEY-----": [("pem", 0, 31)],
        "eyJabcdefgh.eyJabcdefgh.abcdefgh": [("jwt", 0, 32)], "eyJabc.eyJabc.abc": [], "é eyJabcdefgh.eyJabcdefgh.abcdefgh": [("jwt", 2, 34)],
    }
    for (text, want), found in zip(cases.items(), secret_scan.find_spans(list(cases))):
        assert [(kind, a, b) for a, b, kind, _ in found] == want
        assert all(text[a:b] == s for a, b, _, s in found)


def test_contamination_matches_a_plain_search(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (0, 1, 2, 5, 13, 14, 30, 40)] + [None, "W1-w2"]
    texts = ODD + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(100)]
    texts += [f"a B c {items[k]} d, {items[k].upper()}!" for k in (3, 4, 5, 6, 7)]
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], "item_id int, text string, h string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in enumerate(items):
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    got = {r.doc_id: r for r in decontamination.contamination(docs_of(spark, texts), bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = word.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontamination.contamination(docs_of(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(docs_of(spark, []), bench).count() == 0


def test_a_benchmark_beyond_what_is_broadcast(spark, monkeypatch):
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(9)]
    items = [(i if i % 7 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 50))) for _ in range(40)] + [f"{a} {b[1]} {a}" for a, b in zip(vocabulary * 7, items)] + [None, ""]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts[:3]))
    plain = sorted(decontamination.contamination(docs, bench).collect())
    assert len(plain) == len(texts) + 3 and sum(r.contaminated for r in plain) > 60
    monkeypatch.setattr(decontamination, "WINDOW_BYTES", 0)
    assert sorted(decontamination.contamination(docs, bench).collect()) == plain
    monkeypatch.setattr(decontamination, "HASHES", 0)
    assert sorted(decontamination.contamination(docs, bench).collect()) == plain


def test_rows_that_come_often_are_dealt_in_blocks(spark):
    rows = spark.createDataFrame([(1, 25), (2, 1), (None, 11), (3, 10)], "doc_id int, n long")
    got = Counter(r.doc_id for r in base.repeated(rows, "n", "doc_id", block=10).collect())
    assert got == {1: 25, 2: 1, None: 11, 3: 10}


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    docs = docs_of(spark, ["é", None, "abc"] * 400).unionByName(spark.createDataFrame([(7, "é", "en", "x", "y")] * 50 + [(None, "n", "en", "x", "y")], SCHEMA))
    rows = sharding.shard_rows(docs).collect()
    assert len(rows) == 1251 and all(r.grown_shard in (r.shard, 24) for r in rows)
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.size == len((["é", None, "abc"][r.doc_id % 3] or "").encode()) + 8 for r in rows if r.doc_id is not None and r.doc_id != 7)
    heavy = sharding.shard_rows(docs_of(spark, ["t"] * 6000), 2, [3.0, 1.0]).groupBy("shard").count().collect()
    assert 0.7 < {r.shard: r["count"] for r in heavy}[0] / 6000 < 0.8
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("hot", [100_000, 4])
def test_simhash_links_match_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot)
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(rng.randrange(1, 12)):
            for k in rng.sample(range(64), rng.randrange(1, 4)):
                v ^= 1 << k
            values.add(v)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"))).collect()}
    assert {v: got.get(v, v) for v in signed} == brute_components(signed)


def test_simhash_groups_and_deduplication(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(400)) for _ in range(6)]
    texts = ODD + base + base[:3] + [b.replace(" w1 ", " w2 ", 1) for b in base]
    docs = docs_of(spark, texts)
    rows = {r.doc_id: r for r in simhash.groups(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert all(rows[i].fp & (2**64 - 1) == p for i, p in prints.items())
    roots = brute_components(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    assert all(rows[i].component_id == least[roots[p]] for i, p in prints.items())
    kept = simhash.deduplicated(docs.unionByName(docs.filter("doc_id < 3")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.groups(docs.limit(0)).count() == 0


def test_deduplication_tells_texts_under_one_id_apart(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"w{rng.randrange(500)}" for _ in range(400)) for _ in range(4))
    near = a + " end"
    assert (brute_fingerprint(a) ^ brute_fingerprint(near)).bit_count() <= 3
    rows = [(1, a, "en"), (5, a, "en"), (5, b, "en"), (5, c, "de"), (5, c, "en"), (6, d, "en"), (6, d + " end", "en"), (None, a, "en"), (1, near, "en"), (7, b, "en")]
    docs = spark.createDataFrame([(i, t, g, "x", "y") for i, t, g in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()]
    assert len(kept) == len(set(kept)) == 5
    assert {(5, b), (5, c), (None, a)} < set(kept)
    assert sum(i == 1 and t in (a, near) for i, t in kept) == sum(i == 6 and t in (d, d + " end") for i, t in kept) == 1


def test_a_repeated_row_sends_no_other_text_through_an_exchange(spark, tmp_path):
    """The one aggregate over whole rows has those whose keys repeat, by a broadcast semi-join; others meet broadcasts only."""
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(40)]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts[:1])).unionByName(spark.createDataFrame([(1, texts[1], "de", "x", "y")], SCHEMA))
    docs.write.parquet(str(tmp_path / "docs"))
    kept = simhash.deduplicated(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    others, repeats = kept._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [doc_id")
    assert repeats.split("\n")[1].strip().startswith("+- Join LeftSemi") and repeats.count("strategy=broadcast") == 2
    assert others.count("Join LeftAnti") == others.count("strategy=broadcast") == 2 and "Repartition" not in others + repeats


def test_toxicity_learns_words_and_keeps_clean_rows(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "lu") for b in ("ran", "tes", "mil", "son")]
    texts, toxic = [], []
    for i in range(300):
        t = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            t[rng.randrange(30)] = "vileword"
            t[rng.randrange(30)] = "nastything"
        texts.append(" ".join(t))
        toxic.append(i % 4 == 0)
    docs = docs_of(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, int(y), 1) for i, y in enumerate(toxic)] + [(None, 1, 1), (5, None, 1)], "doc_id bigint, toxic int, h int")
    model = toxicity.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert [got[i].toxic for i in range(300)] == toxic and not got[300].toxic and not got[301].toxic
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 227
    assert toxicity.clean(docs, toxicity.train(docs, labels.limit(0))).count() == 302


def test_gam_scores_held_out_rows(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["it", "was", "over", "there"]) + ("$$$" if i % 3 == 0 else "") for _ in range(rng.randrange(5, 80))) for i in range(400)]
    docs = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)], "doc_id bigint, quality int")
    rows = {r.doc_id: r for r in quality_gam.classify(docs, quality_gam.train(docs, labels)).collect()}
    assert len(rows) == 402 and all(0 <= r.score <= 1 for r in rows.values())
    held = [r for i, r in rows.items() if i < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) >= 0.98 * len(held)
    assert quality_gam.classify(docs, quality_gam.train(docs, labels.limit(0))).count() == 402


def test_gam_counts_the_letters_of_whole_texts():
    rng = random.Random(11)
    texts = ["a1" * 1000, "| 12 ab |\n" * 3000] + ["".join(rng.choice(["é1 ", "abc", "99", "\u00a0", "\n", "中"]) for _ in range(rng.randrange(1, 9000))) for _ in range(30)]
    at = quality_gam.FEATURES.index("letter_share")
    for t in filter(str.strip, texts):
        assert quality_gam.features(t)[at] == sum(map(str.isalpha, t)) / len("".join(t.split()))


def test_personal_data_matches_plain_patterns():
    rng = random.Random(10)
    parts = ["a", "b.c", "@", "x-y.com", ".", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-0100", "10.0.0.1", "256.1.1.1", "1", "-", " ", "0", "é", "+", "(", "1.2.3.4.5"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m.group() if c.isdigit()]
            if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
                want.append(("card", m.start(), m.end()))
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        assert pii.base_spans(t) == want, t


@pytest.mark.parametrize("sent", [200_000, 0])
def test_context_discovers_unseen_identifiers(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "MOST_SENT", sent)
    long = "9" * 40 + "-" + "8" * 70
    seeds = [f"hello there contact {n}@mail.com today please" for n in "abcdefgh"]
    texts = [*seeds, "we contact user-99887766 today ok", "see part-55443322 now", None, "", f"do contact {long} today", f"contact {'! ' * 200}user-1234567{' .' * 300} today"]
    docs = docs_of(spark, texts)
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    spans = {i: [texts[i][s.start : s.end] for s in r.extra] for i, r in rows.items() if r.extra}
    assert spans == {8: ["user-99887766"], 12: [long], 13: ["user-1234567"]}
    assert rows[10].spans == [] and len(rows) == len(texts)
    red = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert red[8] == "we contact [CONTEXT] today ok" and red[0] == "hello there contact [EMAIL] today please" and red[10] is None and red[9] == "see part-55443322 now" and red[12] == "do contact [CONTEXT] today"
    assert pii.redacted(docs).columns == docs.columns and pii.find(docs.limit(0)).collect() == pii.redacted(docs.limit(0)).collect() == []


def around(text, *spans):
    cut = pii._Words(text, list(spans))
    return [cut.around(a, b) for a, b in spans]


def test_neighbours_are_words_however_far():
    text = "Alpha, " + " . " * 500 + "X" * 1000 + " (id-123456) " + "!? " * 300 + "'Omega'" + "z" * 900 + " end"
    a = text.index("id-1")
    assert around(text, (a, a + 9)) == [("x" * 1000, "omega")]
    assert around("id-123456", (0, 9)) == [(pii.START, pii.END)]
    assert around(" .. id-123456 ??" + " " * 400, (4, 13)) == [(pii.START, pii.END)]
    assert around("key:a~b1111,c2222 D", (6, 11), (12, 17)) == [("a~", "c2222"), ("b1111", "d")]
    assert around("k~xy~l", (2, 3), (3, 4), (2, 4)) == [("k~", "y"), ("x", "~l"), ("k~", "~l")]


def test_neighbours_by_plain_loops():
    """Every character is a letter of a word or not; words also part where mentions begin and end."""
    rng = random.Random(14)
    for _ in range(400):
        text = "".join(rng.choice("abC~1 ,.\n\u2003É=") for _ in range(rng.randrange(1, 40)))
        spans = [tuple(sorted(rng.sample(range(len(text) + 1), 2))) for _ in range(rng.randrange(1, 5))]
        cuts = {x for s in spans for x in s}
        pieces, own = [], ""
        for i, c in enumerate(text + " "):
            inside = i < len(text) and not c.isspace() and c not in pii._EDGE
            if own and (not inside or i in cuts):
                pieces.append((i - len(own), i, own.lower()))
                own = ""
            own += c if inside else ""
        want = [([w for _, e, w in pieces if e <= a] or [pii.START], [w for s, _, w in pieces if s >= b] or [pii.END]) for a, b in spans]
        assert around(text, *spans) == [(left[-1], right[0]) for left, right in want]


@pytest.mark.parametrize("kind", ["numbers", "json", "one word"])
def test_texts_without_blanks_cost_what_they_are_long(kind):
    """A megabyte in less than three seconds, and mentions with their neighbours in some times its bytes."""
    import time
    import tracemalloc

    text = {"numbers": ",".join(str(1_000_000 + i) for i in range(131_000)), "json": "{" + ",".join(f'"k{i}":{{"id":{10**7 + i},"v":"x-{i}"}}' for i in range(30_000)) + "}", "one word": "~".join(str(1_000_000 + i) for i in range(131_000))}[kind]
    assert len(text) > 1_000_000
    began = time.time()
    spans, met = pii.mentions(text)
    array = pii._lists([met], pii._MENTION_FIELDS)
    assert time.time() - began < 3 and len(met) >= 30_000 and array.nbytes < 20 * len(text)
    tracemalloc.start()
    pii._lists([pii.mentions(text)[1]], pii._MENTION_FIELDS)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def plain_trusted(found, rounds, min_seeds, min_texts, confidence):
    """Trusted patterns and their scores by loops over the whole graph. found: (text, string, left, right, is a seed)."""
    edges, texts = {}, {}
    for text, string, left, right, seed in found:
        edges.setdefault((left, right), {}).setdefault(string, False)
        edges[left, right][string] |= seed
        texts.setdefault((left, right), set()).add(text)
    graph = {p: s for p, s in edges.items() if len(s) >= min_seeds and len(texts[p]) >= min_texts}
    known = {(p, s): 1.0 if seed else None for p, own in graph.items() for s, seed in own.items()}
    trusted = {}
    while True:
        held = {p: own for p, own in graph.items() if sum(known[p, s] is not None for s in own) >= min_seeds}
        weight = {(p, s): known[p, s] or 0.0 for p, own in held.items() for s in own}
        for _ in range(rounds - 1):
            score = {p: sum(weight[p, s] for s in own) / len(own) for p, own in held.items()}
            best = {}
            for p, own in held.items():
                for s, seed in own.items():
                    if not seed:
                        best[s] = max(best.get(s, 0.0), score[p])
            weight = {(p, s): 1.0 if held[p][s] else max(known[p, s] or 0.0, best.get(s, 0.0)) for p, s in weight}
        score = {p: sum(weight[p, s] for s in own) / len(own) for p, own in held.items()}
        added = {p: x for p, x in score.items() if x >= confidence and p not in trusted}
        if not added:
            return trusted
        trusted |= added
        earned = {}
        for (p, s), k in known.items():
            if k is None and p in added:
                earned[s] = max(earned.get(s, 0.0), added[p])
        for p, s in known:
            if known[p, s] is None and s in earned:
                known[p, s] = earned[s]


def test_the_graph_equals_plain_loops_on_random_mentions(spark):
    rng = random.Random(21)
    sizes = []
    for turn in range(3):
        strings = {f"s{i}": rng.random() < 0.45 for i in range(40)}
        found = []
        for _ in range(260):
            s = rng.choice(list(strings))
            found.append((rng.randrange(30), s, f"l{min(rng.randrange(8), rng.randrange(8))}", f"r{rng.randrange(2)}", strings[s] and rng.random() < 0.95))
        rows = {}
        for text, *m, seed in found:
            rows.setdefault(text, []).append((*m, seed, 0, 1))
        frame = spark.createDataFrame(list(rows.items()), "row_key long, mentions array<struct<string: string, left: string, right: string, seed: boolean, start: long, end: long>>")
        bar = (3, 3, rng.choice([0.45, 0.55, 0.65]))
        got = {(r.left, r.right): r.score for r in pii.trusted_patterns(frame, 3, *bar).collect()}
        want = plain_trusted(found, 3, *bar)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        sizes.append(len(want))
    assert max(sizes) > 3


def test_identifiers_alone_in_their_texts(spark):
    docs = docs_of(spark, [f"{n}@mail.com" for n in "abcdefg"] + ["user-99887766", "the user-99887766"])
    assert {r.doc_id: len(r.extra) for r in pii.find(docs).collect()} == {**dict.fromkeys(range(7), 0), 7: 1, 8: 0}


def test_discovered_identifiers_vouch_for_further_patterns(spark):
    seeds = [f"hello there contact {n}@mail.com today please" for n in "abcdefgh"]
    first = [f"we contact user-9988776{k} today ok" for k in range(5)] + [f"a badge user-9988776{k} opens it" for k in range(5)]
    second = [f"a badge staff-5544332{k} opens it" for k in range(2)]
    few = [f"see part user-9988776{k} now" for k in range(2)] + [f"see part bolt-1122334{k} now" for k in range(4)]
    texts = seeds + first + second + few
    rows = {r.doc_id: r for r in pii.find(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = [m.span() for m in re.finditer(r"(user|staff)-[0-9]+", t)] if t not in few else []
        assert [(s.start, s.end) for s in rows[i].extra] == want, t


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_rows_are_removed_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(base, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "b"), (2, None), (2, None), (3, "c")], "doc_id long, text string")
    gone = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None), (9, "z")], "doc_id long, text string")
    assert sorted(map(str, base.without(docs, gone, ["doc_id", "text"]).collect())) == sorted(map(str, docs.filter("(doc_id = 1 AND text = 'b') OR (doc_id IS NULL AND text = 'a') OR doc_id = 3").collect()))
    assert base.without(docs, gone.limit(0), ["doc_id", "text"]).count() == 7
