"""Repair of conversations, lexical search and byte-level BPE against brute-force versions, on rows with nulls, ties, repeats and odd texts."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from weft.llm import _bytes, bytebpe, lexical, repair
from weft.llm._tokens import tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")


# -- conversations


def all_repairs(codes):
    """Every audit of up to two inserts, by its letters alone."""
    best = None
    rows = len(codes)
    for letters in itertools.product("DKR", repeat=rows):
        for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(rows + 1), k) for k in range(3)):
            audit = "".join("I" * places.count(i) + (letters[i] if i < rows else "") for i in range(rows + 1))
            cost, roles, row = 0, "", 0
            for letter in audit:
                want = "a" if roles[-1:] == "u" else "u"
                if letter == "I":
                    cost, roles = cost + 5, roles + want
                    continue
                code, row = codes[row], row + 1
                if letter == "D":
                    cost += 2
                    continue
                cost += (letter == "R") + 5 * (code & 8 > 0) + 1000 * (code & 4 > 0)
                roles += want if letter == "R" else "sua-"[code & 3]
            if cost < 1000 and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cheapest_repair_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(150):
        codes = bytes(rng.choice([0, 1, 2, 3, 1, 2]) + rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randint(0, 5)))
        assert repair.cheapest_repair(codes) == all_repairs(codes), list(codes)


def test_search_follows_the_rows():
    rng = random.Random(5)
    codes = bytes(rng.choice([0, 1, 2, 3, 1, 2]) + rng.choice([0, 0, 0, 4, 8]) for _ in range(30_000))
    cost, audit = repair.cheapest_repair(codes)
    assert len(audit.replace("I", "")) == 30_000 and cost <= 60_000


CONV = "conv_id long, turn long, role string, text string, audit string, own int"


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 7)):
            turn = None if rng.random() < 0.05 else t + (rng.random() < 0.2)
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((c, turn, role, rng.choice(["Yes.", "No", "", " \x0b", None, "what? ", "a.\x1c", "é!", f"w{t}."]), "x", 1))
    rows += [rows[3], rows[3], (None, 1, "user", "no id.", None, None), (None, None, None, None, None, None), (77, 2**40, "user", "far.", "", 0), (77, -5, "user", "apart.", "", 0)]
    return spark.createDataFrame(rows, CONV), rows


def repaired(rows):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, digest), by the words of the contract, with a plain dynamic program."""
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append((t is not None, t or 0, t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, own in by.items():
        own.sort()
        seen, marks, counts = set(), [], collections.Counter()
        for *_, r, x in own:
            last = re.findall(r"[^\x20\x09-\x0D]", x)[-1:]
            fault = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((r, x))
            marks.append(fault)
            counts[fault] += 1
        best = {"": (0, "", [])}
        close = lambda b: [b.update({w: min(b.get(w, v), v)}) for v, w in [((n + 5, a + "I", [*k, ("user" if s[-1:] != "u" else "assistant", "")]), step(s)) for s, (n, a, k) in list(b.items())]]
        step = lambda s: "u" if s[-1:] != "u" else "a"
        for (*_, r, x), fault in zip(own, marks, strict=True):
            close(best), close(best)
            then = {}
            for s, (n, a, k) in best.items():
                put = lambda w, v: then.update({w: min(then.get(w, v), v)})
                put(s, (n + 2, a + "D", k))
                if fault in ("", "truncated"):
                    n += 5 * (fault == "truncated")
                    if r[:1] == step(s) or (r[:1] == "s" and s == ""):
                        put(r[:1], (n, a + "K", [*k, (r, x)]))
                    put(step(s), (n + 1, a + "R", [*k, ({"u": "user", "a": "assistant"}[step(s)], x)]))
            best = then
        close(best), close(best)
        cost, audit, kept = min(v for s, v in best.items() if s in ("", "a"))
        turns = [t for _, _, t, *_ in own if t is not None]
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def test_repair_plans_and_digests(spark, conversations):
    df, rows = conversations
    want = repaired(rows)
    plans = repair.repair_plans(df)
    got = {r[0]: tuple(r[1:]) for r in plans.collect()}
    assert got == {c: v[:-1] for c, v in want.items()}
    digests = dict(repair.repaired_digests(repair._plain(df, "conv_id", "turn", "role", "text"), plans).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert {c: digests.get(c, none) for c in want} == {c: v[-1] for c, v in want.items()}
    whole = repair.repair_conversations(df).collect()
    for c in want:
        own = sorted((r for r in whole if r.conv_id == c), key=lambda r: r.place)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own)) and [r.edit for r in own] == [x for x in want[c][6] if x != "D"]
    assert repair.repair_plans(df.limit(0)).collect() == [] and repair.repair_conversations(df.limit(0)).collect() == []


def test_damage(spark, conversations):
    df, rows = conversations
    got = collections.Counter(tuple(r) for r in repair.damaged(df).collect())
    want = collections.Counter()
    for c, t, r, x, *_ in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x, r = " " if x is None else x, " " if r is None else r
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        want[(c, t, "user" if fault == 4 else r, x)] += {0: 0, 3: 2}.get(fault, 1)
    assert got == +want


def _agree(spark, tmp_path, name, tables, query, sql):
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{name}/{t}.parquet/*.parquet'")
    got, want = query(spark, f"{tmp_path}/{name}").collect(), c.sql(sql)
    names = want.columns
    key = lambda r: [(v is not None, v) for v in r]
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want.fetchall(), key=key)
    return got


def test_conversations_agree_with_their_sql(spark, tmp_path, conversations):
    assert len(_agree(spark, tmp_path, "a", {"conversations": conversations[0]}, repair.op11_repair_conversations, repair.OP11_SQL)) == 42
    assert _agree(spark, tmp_path, "b", {"conversations": conversations[0].limit(0)}, repair.op11_repair_conversations, repair.OP11_SQL) == []


# -- lexical search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    vocab = ["The", "the", "of", "naïve", "Straße", "İs", "x1", "日本", "go", *(f"w{i}" for i in range(30)), "q" * 90]
    line = lambda n: rng.choice([" ", ", ", "\n", "_"]).join(rng.choice(vocab) for _ in range(n))
    docs = [(i, line(rng.randint(0, 40)), 1, 2) for i in range(150)]
    docs += [(200 + i, docs[5][1], 1, 2) for i in range(70)] + [docs[5], docs[6], (None, docs[5][1], 1, 2), (None, None, 1, 2), (301, None, 1, 2), (302, "", 1, 2), (303, "-- !", 1, 2), (304, line(9000), 1, 2)]
    items = [(f"i{i}", line(rng.randint(1, 12)), 5) for i in range(12)] + [("none", None, 5), ("blank", " .", 5), ("odd", "nowhere else", 5), (None, "the w1 w1", 5), ("i0", "go", 5)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int, rank int").repartition(3), spark.createDataFrame(items, "item_id string, text string, m int"), docs, items


def ranks(docs, items, k):
    terms = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(d, collections.Counter(terms(t))) for d, t, *_ in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text, *_ in items:
        found = []
        for d, b in bags:
            m = 100 - 50 + (50 * b.total() * n_docs) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3, 50, 1000])
def test_rank_documents(corpus, k):
    docs, items, d, i = corpus
    assert sorted((tuple(r) for r in lexical.rank_documents(docs, items, k).collect()), key=str) == ranks(d, i, k)


def test_ranks_by_blocks_and_whole_numbers(corpus, monkeypatch):
    docs, items, d, i = corpus
    monkeypatch.setattr(lexical, "BLOCK_ENTRIES", 60)
    monkeypatch.setattr(lexical, "CHUNK_ENTRIES", 40)
    assert sorted((tuple(r) for r in lexical.rank_documents(docs, items, 7).collect()), key=str) == ranks(d, i, 7)
    assert lexical.rank_documents(docs.limit(0), items).collect() == [] and lexical.rank_documents(docs, items.limit(0)).collect() == []


def test_search_agrees_with_its_sql(spark, tmp_path, corpus):
    docs, items, *_ = corpus
    where = {"documents": docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "benchmark": items.where("item_id IS NOT NULL").dropDuplicates(["item_id"])}
    assert _agree(spark, tmp_path, "c", where, lexical.op12_lexical_search, lexical.OP12_SQL)


def test_equal_hashes_of_other_terms_stay_apart():
    words = lexical.Vocabulary(["aa", "bb"])
    raw = np.frombuffer(b"ab bb", np.uint8)
    starts, ends, keys = lexical._hashed(raw)
    keys = keys.copy()
    keys[0] = lexical._hashed(np.frombuffer(b"aa", np.uint8))[2][0]  # as if the hashes were equal
    assert words.find(raw, starts, ends, keys).tolist() == [-1, 1]


# -- byte-level BPE


def odd_texts():
    rng = random.Random(8)
    parts = [*"abcstvrelmd'''   \n\t 　\x85 1２٣²½!?.,é日本語̈🙂ǅ \x1c\x00​_", "'s", "'re", "'ll", " '", "<|endoftext|>", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_words_are_the_library_s(monkeypatch):
    splitter = _bytes.Splitter(BPE)
    for window in (1 << 20, 5):
        monkeypatch.setattr(_bytes, "WINDOW", window)
        for text in odd_texts():
            data, begin = splitter.split(splitter.segments(text))
            got = [data[a:b].tobytes().decode() for a, b in itertools.pairwise(begin.tolist())]
            want = []
            for i, part in enumerate(text.split("<|endoftext|>")):
                want += (["<|endoftext|>"] if i else []) + [part[a:b] for _, (a, b) in splitter.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            assert got == want, text


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_encode_and_decode(spark, monkeypatch, block):
    monkeypatch.setattr(bytebpe, "BLOCK_WORDS", block)
    texts = [*odd_texts(), None, "", "x" * 70_000, "word " * 30_000, "same", "same"]
    rows = [(None if i % 50 == 7 else i // 2 * 2, t, 1, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(3)
    encoded = bytebpe.encode_documents(docs)
    got = collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in bytebpe.decode_documents(encoded).collect())
    tokenizer = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(d, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bytebpe.encode_documents(docs.limit(0)).collect() == []


def test_ids_that_are_no_text_decode_as_the_library_does(spark):
    tokenizer, rng = Tokenizer.from_file(BPE), random.Random(9)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 9))] for _ in range(200)] + [[50256], [94, 95, 96]]
    df = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)], "doc_id long, ids binary")
    for r in bytebpe.decode_documents(df).collect():
        assert r.decoded == tokenizer.decode(lists[r.doc_id], skip_special_tokens=False)


def test_round_trip_query(spark, tmp_path):
    texts = odd_texts()[:50]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(BPE)
    for r in bytebpe.op13_bpe_round_trip(spark, str(tmp_path)).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
