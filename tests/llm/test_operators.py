"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from shelfloom.llm import ann, bpe, chat, exact_dedup, html_text, licenses, mixing, near_dedup, pii, quality, queries

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, rid long, grp long, component string"


def fold(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fixture_rows() -> list[tuple]:
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 120))) for _ in range(12)]
    texts: list[str | None] = [None, "", "   \n", "one", "one two", "ONE\ttwo", "é \U0001f600 x", "w " * 5000 + "end", "x" * 70_000, *base]
    for text in base[:6]:
        words = text.split(" ")
        for _ in range(5):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts += [text, text.replace(" ", "  \n"), text.upper()]
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or ""), 1, True, 2, 3, "c") for k, t in enumerate(texts)]
    rows.append(rows[10])  # a repeated row
    rows.append((None, base[0], "en", "s1", 5, 1, True, 2, 3, "c"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs):
    rows = fixture_rows()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for r in rows:
        ids = groups[norm(r[1])]
        want[r[0], min(i for i in ids if i is not None), len(ids), hashlib.sha256(norm(r[1]).encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(docs, first_width=3, growth=2).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {norm(r["text"]) for r in kept.collect()} == set(groups)


def test_drop_copies_leaves_other_columns_alone(spark):
    """Columns whose names the operators might want for themselves keep their values; repeated rows of blanks stay."""
    names = ["__n", "__sha", "__keep", "__key", "__doc", "__id", "__of", "digit", "rid", "first", "lead", "text_key"]
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "same text"), (2, "same  text"), (3, base), (4, base + " more"), (5, "  "), (5, "  "), (6, None), (6, None), (7, "same text"), (3, base), (None, ""), (None, "")]
    full = [(d, t, *(f"{name}{d}" for name in names)) for d, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    exact = exact_dedup.drop_exact_copies(docs)
    assert exact.columns == docs.columns
    assert Counter(map(tuple, exact.collect())) == Counter([full[0], full[2], full[3], full[4], full[6]])
    near = near_dedup.drop_near_copies(docs)
    assert near.columns == docs.columns
    assert Counter(map(tuple, near.collect())) == Counter([full[0], full[2], *full[4:8], *full[10:]])


def components(rows: list[tuple], size: int) -> dict:
    sets = []
    for r in rows:
        w = re.findall("[^\x20\x09-\x0d]+", fold(r[1]))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            members[find(k)].append(r[0])
    return Counter((r[0], len(sets[k]), min(members[find(k)]), r[0] == min(members[find(k)])) for k, r in enumerate(rows))


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates(docs, rounds):
    """Without star rounds every candidate pair comes from comparing buckets in blocks."""
    near_dedup.BLOCK, before = 8, near_dedup.BLOCK
    try:
        got = near_dedup.near_duplicates(docs, 4, rounds=rounds).collect()
    finally:
        near_dedup.BLOCK = before
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == components(fixture_rows(), 4)


def test_drop_near_copies(docs):
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = fixture_rows()
    n = len({c for _, s, c, _ in components(rows, 5) if s}) + sum(not (r[1] or "").split() for r in rows)
    assert kept.count() == n


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {v: v for e in edges for v in e}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_mix_equals_its_targets(docs, duck):
    got = mixing.mix(docs, block=64).collect()
    taken, size, target = Counter(), Counter(), {}
    sources = {r[0]: r[3] for r in fixture_rows()}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            s = sources[r["doc_id"]]
            taken[s] += r["taken"]
            size[s] += r["size"]
            target[s] = r["target"]
    assert all(target[s] <= 2 * max(r["source_size"] for r in got if r["doc_id"] is not None and sources[r["doc_id"]] == s) for s in target)
    assert all(taken[s] == int(target[s]) for s in target if s != "s1")
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    again = mixing.mix(docs.repartition(5), block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_blocks_are_the_schedule(spark):
    """Slots and texts by hand: points through cumulative targets, a rank for each source, blocks of its shuffled documents."""
    rng, rows = random.Random(4), []
    for k in range(60):
        source = rng.choice(["a", "a", "b", "c", None])
        rows.append((k, source, None if k == 7 else " \n".join(f"w{k}_{n}" for n in range(rng.randint(0, 40)))))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    target = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("size").alias("source_size"))).collect()}
    order = sorted(target, key=lambda s: (s is None, s or ""))
    words = {s: [w for k, _, t in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()) for w in (t or "").split()] for s in order}
    total, edges = sum(t for _, t in target.values()), np.cumsum([target[s][1] for s in order])
    want, taken = {}, Counter()
    for i in range(int(np.ceil(total / 16))):
        s = order[min(int(np.searchsorted(edges / total, i * mixing.GOLDEN % 1.0, "right")), len(order) - 1)]
        done, own = taken[s], words[s]
        if done >= int(target[s][1]):
            continue
        at = done % len(own)
        part = own[at : at + 16][: int(target[s][1]) - done]
        taken[s] += len(part)
        want[i, s] = " ".join(part)
    got = {(r["slot"], r["source"]): r for r in mixing.mixed_blocks(docs, block=16).collect()}
    late = {k for k in got if k[0] >= int(np.ceil(total / 16))}
    assert {k: r["text"] for k, r in got.items() if k not in late} == want and len(late) < 8
    assert all(r["n_words"] == len(r["text"].split()) <= 16 for r in got.values())
    first = {}
    for (slot, _), r in sorted(got.items(), key=lambda x: x[0][0]):
        for d in r["doc_ids"]:
            first.setdefault(d, slot)
    assert {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs, block=16).collect() if r["taken"]} == first


def test_repeat_taken(docs):
    """Rows that repeat are taken each, texts without words go, and no column changes."""
    times = Counter()
    for r in mixing.mix(docs, block=64).collect():
        times[r["doc_id"]] += -(-r["taken"] // r["size"]) if r["size"] else 0
    got = mixing.repeat_taken(docs, block=64)
    rows = set(fixture_rows())
    out = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and set(out) <= rows and all((r[1] or "").split() for r in out)
    assert Counter(r[0] for r in out) == +times


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    order = sorted(columns)
    assert sorted(got.columns) == order
    as_row = lambda r: tuple(round(float(v), 6) if isinstance(v, (int, float)) else v for v in r)
    assert Counter(as_row(r[c] for c in order) for r in got.collect()) == Counter(as_row(r[columns.index(c)] for c in order) for r in want.fetchall())


def test_bpe_equals_tiktoken(docs):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = {r[0]: r[1] or "" for r in fixture_rows()}
    for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect():
        text = rows[r["doc_id"]]
        ids = plain.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert all(plain.decode([i]) == text[a:b] for i, a, b in zip(ids, r["starts"], r["ends"], strict=True) if "�" not in plain.decode([i]))


def test_bpe_white_space_and_split_characters():
    model = bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x180)] + ["\x1c", " ", "　", "\U0001f600", " the", "  ", " \n", "'s", " "] * 20
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 20))) for _ in range(3000)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert "".join(model.decode_text(ids)) == text and model.decode(ids).decode() == text


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [(m.start(), 2, m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PII = [
    None, "", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "+1 (555) 123-4567+44 20 7946 0958 4111 1111 1111 1111 4111-1111-1111-1112 x@y a@b.c@d.e",
    "\U0001f600 joe@x.org", "1 " * 20_000, "1" * 50_000, "a" * 50_000 + "@", "+1" + "(" * 30_000, "é@x.com Ünal.b@x-y.co.uk," * 20, "12.34.56.78", "5500005555555559",
]


def test_personal_data_base(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(PII)] + [(2, PII[2])], "doc_id long, text string")
    got = pii.digests(pii.find_personal_data(df)).collect()
    names = [n for n, _, _ in pii.PATTERNS]
    assert len(got) == len(PII) + 1
    for r in got:
        spans = base_spans(PII[r["doc_id"]] or "")
        assert [r[f"n_{n}"] for n in names] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_redaction_leaves_other_columns_alone(spark):
    names = ["own", "marks", "__id", "__spans", "spans", "base"]
    rows = [(1, "Mail bob@example.org now", *names), (2, None, *names), (None, "x", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = pii.redact(docs, pii.find_personal_data(docs.select("doc_id", "text").where("doc_id = 1"), least_texts=2))
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter([(1, "Mail [EMAIL] now", *names), (2, "", *names), (None, "x", *names)])


def test_disclosing_terms_are_found_and_redacted(spark):
    rows = [(k, f"filler{k} word{k}.\nmail zorblax joe@x.org today please number{k}") for k in range(6)] + [(10 + k, f"today please mail to nobody about thing{k} again please and mail") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal_data(df)
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df, found).collect()}
    assert texts[0] == "filler0 word0.\nmail  [EMAIL] today please number0"
    assert all(texts[d] == t for d, t in rows if d >= 10)


@pytest.mark.parametrize("line", ["Vogel: v@x.org today", "today v@x.org Vogel", "today (Vogel) v@x.org please", 'today v@x.org "Vogel\'s" please'])
def test_disclosing_terms_at_the_ends_of_lines_and_in_brackets(spark, line):
    rows = [(k, f"x{k}\n{line}\n{k}") for k in range(4)] + [(10 + k, f"today please mail {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["name"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(df).collect()}
    for d, text in rows:
        want = [("term", m.start(), m.end()) for m in re.finditer("Vogel", text)]
        assert [s for s in found[d] if s[0] == "term"] == want and (d >= 10 or want)


def test_disclosing_terms_count_by_document(spark):
    far = "today please " * 30
    rows = [(k, f"Vogel wrote{k}\n{far}\nmail v@x.org and Vogel's again{k} {far} (vogel) Berta") for k in range(4)] + [(k, f"Berta {far}\n v@x.org {far} vogel x4") for k in (4, 5)]
    rows += [(10 + k, f"{far} mail and again {k}") for k in range(58)] + [(90, "Berta is elsewhere"), (91, "Berta again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"], s["action"]) for s in r["spans"] if s["name"] == "term"] for r in pii.find_personal_data(df).collect()}
    # 66 documents, 6 with the entity: vogel is only there, berta in two more
    assert 0.75 <= np.log2(66 * 6 / (6 * 8)) / np.log2(66 / 6) < 0.9
    for d, text in rows:
        want = [(m.start(), m.end(), "remove" if m[0].lower() == "vogel" else "generalise") for m in re.finditer("(?i)vogel|berta", text)]
        assert found[d] == (want if d < 10 else [])


def plain_terms(rows: list[tuple], least_texts: int, generalise: float, remove: float) -> dict[int, list]:
    """Term spans by definition: document frequencies of every word and every personal value, over whole texts."""
    term = regex.compile(r"(?<![\p{L}\p{N}])\p{L}{3,}(?![\p{L}\p{N}])")
    blank = lambda t: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: " " * len(m[0]), t)
    words = [{m[0].lower() for m in term.finditer(blank(t or ""))} for _, t in rows]
    held = [{(k, t[a:b].lower()) for a, k, b in base_spans(t or "")} for _, t in rows]
    n, out = len(rows), {}
    for (d, t), own, mine in zip(rows, words, held, strict=True):
        best: dict[str, float] = {}
        for e in mine:
            with_e = [i for i in range(n) if e in held[i]]
            for w in own:
                both = [i for i in with_e if w in words[i]]
                if len({rows[i][1] for i in both}) >= least_texts and len(with_e) < n:
                    with_w = sum(w in x for x in words)
                    best[w] = max(best.get(w, 0), np.log2(n * len(both) / (len(with_e) * with_w)) / np.log2(n / len(with_e)))
        out[d] = [(m.start(), m.end(), "remove" if best[w] >= remove else "generalise") for m in term.finditer(blank(t or "")) if (w := m[0].lower()) in best and best[w] >= generalise]
    return out


@pytest.mark.parametrize("least_texts", [1, 2])
def test_disclosing_terms_equal_brute_force(spark, least_texts):
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(500)] + ["Ünal", "x4y", "o'neil"]
    marks = ["a@x.org", "bob@mail.example.com", "10.0.0.7", "+1 (555) 123-4567", "4111 1111 1111 1111", *(f"u{k}@y.org" for k in range(30))]
    rows = []
    for k in range(150):
        words = rng.choices(pool, [1 / (1 + i) for i in range(len(pool))], k=rng.randint(5, 60))
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randrange(len(words)), marks[k % len(marks)] if rng.random() < 0.8 else rng.choice(marks))
        rows.append((k, rng.choice([" ", "\n", ", "]).join(words)))
    rows += [(200 + k, rows[k][1]) for k in range(30)] + [(300, None), (301, "")]
    want = plain_terms(rows, least_texts, 0.75, 0.9)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"copy": F.lit(1), "term": F.lit("x"), "kind": F.lit(2)})
    got = {r["doc_id"]: [(s["start"], s["end"], s["action"]) for s in r["spans"] if s["name"] == "term"] for r in pii.find_personal_data(df, least_texts).collect()}
    assert sum(map(len, want.values())) > (20 if least_texts == 1 else 0)
    assert got == want


def test_disclosing_terms_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: [(s["start"], s["end"], s["action"]) for s in r["spans"] if s["name"] == "term"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_terms(rows, 1, 0.75, 0.9)
    assert got == want and any(want.values())


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a [1] <b> \\ c"), (1, 2, "tool] x", "y"), (2, 0, "assistant", ""), (2, 1, None, None), (3, 0, "user", "</s>[INST] ok [/INST]"), (3, 0, "user", "</s>[INST] ok [/INST]"),
    (3, 1, "assistant", "\\[INST\\] \\\\ \n[/SYS]"), (None, None, "system", "x" * 30_000), (4, 1, "assistant", "[OUT] é\U0001f600</s>" * 2000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    convs = chat.format_conversations(df)
    assert all(r["same"] for r in convs.collect())
    want = defaultdict(list)
    for c, t, r, x in CHATS:
        want[c].append((t, r or "", x or ""))
    for r in chat.digests(convs).collect():
        turns = sorted(want[r["conv_id"]], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_main_text():
    article = "<article><h1>T &amp; U</h1><p>Short.<p>A  b\n<b>c</b><br>d &copy; e</article>"
    page = f"<html><head><title>x</title><script>var a='<p>no';</script></head><body><nav><a href=a>Menu</a></nav><div class='cookie-notice'>We use cookies</div>{article}<div id=comments><p>Nice the post</p></div><footer>f</footer></body></html>"
    assert html_text.main_text(page) == "T & U\nShort.\nA b c d © e"
    for odd in (None, "", "<", "<p", "<script>x", "<!--", "<div hidden>x</div>", "<nav>a"):
        assert html_text.main_text(odd) == ""
    long = "The of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their. "
    assert html_text.main_text(f"<body><div><a href=x>Home</a> <a href=y>About</a></div><p>{long * 2}</p><p>Short one of it</p><p>{long * 2}</p></body>").count("\n") == 2


PROSE = "The of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you were her all. "


def test_each_pass_of_the_page_rules_decides():
    """Link density takes link lists out of an article; short blocks go with the nearest decided blocks, inside an article and without one."""
    links = "".join(f"<li><a href=x{k}>Some linked story title {k}</a></li>" for k in range(4))
    page = f"<article><h1>T</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><ul><li><a href=a>One more story</a><li>or so<li><a href=b>And another story</a></ul></article>"
    assert html_text.main_text(page).split("\n") == ["T", PROSE.strip(), "Short.", PROSE.strip()]
    page = f"<body><ul>{links}</ul><div>Posted by me</div><ul>{links}</ul><div>A title</div><div>{PROSE}</div><div>Ok.</div><div>{PROSE}</div><ul>{links}</ul>"
    assert html_text.main_text(page).split("\n") == ["A title", PROSE.strip(), "Ok.", PROSE.strip()]
    blocks = html_text.blocks_of(page)
    assert [html_text.first_pass(b) for b in blocks] == ["bad"] * 4 + ["short"] + ["bad"] * 4 + ["short", "good", "short", "good"] + ["bad"] * 4
    assert html_text.second_pass(["good", "short", "bad"], False) == ["good", "bad", "bad"] and html_text.second_pass(["bad", "short", "good"], False)[1] == "good" and html_text.second_pass(["good", "short", "bad"], True)[1] == "good"


def test_second_pass_equals_plain_search():
    rng = random.Random(6)
    for _ in range(300):
        first, inside = rng.choices(["good", "bad", "near", "short"], k=rng.randint(1, 12)), rng.random() < 0.5
        want = []
        for k, kind in enumerate(first):
            if kind in ("near", "short"):
                decided = [(abs(i - k), x) for i, x in enumerate(first) if x in ("good", "bad")]
                near = {x for d, x in decided if d == min(decided)[0]}
                tie = "good" if not near or inside or kind == "near" else next((x for x in first[k:] if x in ("good", "bad")), "")
                kind = near.pop() if len(near) == 1 else tie
            want.append(kind)
        assert html_text.second_pass(first, inside) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p class='advert'>Buy {PROSE}</p><p>{PROSE}</p><ul><li class=share>Share {PROSE}</li><li>{PROSE}</ul></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}<span class='ad'>Buy <b>this</b> now</span>Then more</p></article>", f"{PROSE}Then more"),
        (f"<article><div class='article-header'><h1>The title</h1></div><p>{PROSE}</p></article>", f"The title\n{PROSE}"),
        ("<body><nav><a href=x>Home</a></nav><p>One short paragraph.</p><footer>F</footer>", "One short paragraph."),
        (f"<article><p class=ad>Buy<p>{PROSE}<p>Ok<div hidden><p>No</div></article><p>{PROSE}", f"{PROSE}\nOk"),
        (f"<article><p><a name=top>{PROSE}</p><p><i>a<b>b</i>c</b></p></article>", f"{PROSE}\nabc"),
        ("<article><p>" + "\u6587" * 300 + "</p><ul><li><a href=x>linked list entry</a></ul></article>", "\u6587" * 300),
    ],
)
def test_pages_with_marked_elements(page, want):
    assert html_text.main_text(page) == want.replace(" \n", "\n").strip()


def test_long_and_deep_pages_take_time_in_proportion():
    n = 60_000
    start = time.time()
    assert html_text.main_text("<div>" * n + "</section>" * n + "x") == "x"
    assert html_text.main_text("<p>" + "<b>" * n + "</i>" * n + "x") == "x"
    assert html_text.main_text("<i><div>" + "<b>" * n + "</i>" * n + "x") == "x"
    assert html_text.main_text("<p><a href=x>" * n + "</a>x") == "x" and html_text.main_text(f"<article><p>{PROSE * 20_000}").count(" ") == len(PROSE.split()) * 20_000 - 1
    assert time.time() - start < 20


def test_both_passes_decide_on_pages_of_the_tables(spark):
    """What no element excludes the first pass thins out on every page, and on most the second restores short blocks; the text is the article's."""
    rejected = restored = 0
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()
    for (page,) in rows:
        blocks = html_text.blocks_of(page)
        first, last = html_text.decided(blocks)
        rejected += any(kind == "bad" for b, kind in zip(blocks, first, strict=True) if not b.outside)
        restored += any(one in ("near", "short") and two == "good" for one, two in zip(first, last, strict=True))
        assert [b.text for b, kind in zip(blocks, last, strict=True) if kind == "good"] == [b.text for b in blocks if b.inside and not b.outside]
    assert rejected > 0.9 * len(rows) and restored > 0.5 * len(rows)


def test_pages_of_the_tables(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op4_html(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", rows[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", body[1])) if body else []
        want = [x for p in parts if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()))]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])


def test_license_places_and_templates(spark):
    texts = [
        None, "", "The MIT License, mit-license. Apache License", "GNU General Public  License! general public", "x " * 3000 + "redistribution and use in source and binary forms, with or without modification, are permitted provided that the",
        "permission is granted", "éMIT license", "mitlicense",
    ]
    filler = [(100 + k, f"plain words number {k} about nothing") for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + filler, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == len(texts) + 60
    for k, t in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))
        places = [i for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (got[k]["n_words"], got[k]["n_base"], got[k]["first_word"], got[k]["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
    assert got[4]["labels"] == "bsd" and got[4]["base_labels"] == "" and 0.7 <= got[4]["score"] <= 1
    assert got[2]["base_labels"] == "apache,mit" and got[5]["labels"] == "" and got[100]["score"] == 0


def test_license_scan_adds_labels_of_its_own(spark):
    """The tables hold notices without a base phrase; clashing columns change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"labels": F.lit("x"), "score": F.lit(9), "n_words": F.lit(1)})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    nc = {d for d, t in texts.items() if "Licensed under CC BY-NC 4.0" in (t or "")}
    assert nc and {d for d, r in got.items() if r["labels"] != r["base_labels"]} == nc
    assert all(got[d]["labels"] == "cc-by-nc" and got[d]["base_labels"] == "" and got[d]["score"] == 1 for d in nc)


@pytest.mark.parametrize("plain", [0, 6])
def test_license_notice_in_half_of_the_corpus(spark, plain):
    bsd = " ".join(w.decode() for w in licenses.words_of(next(notice for label, _, notice in licenses.TEMPLATES if label == "bsd")))
    rows = [(k, f"head {k} {bsd}") for k in range(max(plain, 1))] + [(-k, f"plain words number {k}") for k in range(1, plain + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()} == {d: "bsd" if d >= 0 else "" for d, _ in rows}


def test_all_license_notices_of_one_file(spark):
    notices = [(label, key, " ".join(w.decode() for w in licenses.words_of(notice))) for label, key, notice in licenses.TEMPLATES]
    rng, rows = random.Random(5), [" then ".join(n for _, _, n in notices)]
    for _ in range(60):
        words = []
        for _, _, notice in rng.sample(notices, rng.randint(1, 4)):
            words += [w if rng.random() < 0.85 else rng.choice(["changed", "the", "software", "mozilla"]) for w in notice.split()] + rng.choices(["redistribution", "isc", "public", "x"], k=6)
        rows.append(" ".join(words))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[0]["labels"].split(",") == sorted({label for label, _, _ in notices})
    for d, text in enumerate(rows):
        words, labels = text.split(), {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {text} "}
        for label, key, notice in notices:
            n = notice.split()
            for s in range(-len(n), len(words)):
                share = sum(0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(n)) / len(n)
                if share >= 0.7 and f" {key} " in f" {' '.join(words[max(s, 0) : max(s + len(n), 0)])} ":
                    labels.add(label)
        assert got[d]["labels"] == ",".join(sorted(labels)), text


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + 4 * rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    x[1000:1300] = x[1000]  # a very common vector: ties go to smaller ids
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] + [1.0] * 15), (9080, [1.0] * 7), (40, rows[40][1])]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    every = np.array([i for i, v in rows[:3000]] + [40])
    data = np.concatenate([x, x[40:41]])
    hits = total = 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        s = data @ data[q]
        s[q] = -np.inf
        want = every[np.lexsort((every, -s))[:20]].tolist()
        if q != 40:
            assert len(found) == 20 and [(-b, a) for a, b in found] == sorted((-b, a) for a, b in found)
            hits, total = hits + len({a for a, _ in found} & set(want)), total + 20
    assert hits / total >= 0.9
    few = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(0, 60, 20)], "vec_id long, embedding array<float>")
    assert ann.search(few, "vec_id % 20 = 0").count() == 6


def test_reach_visits_cells_in_order():
    rng = np.random.default_rng(1)
    for n in (7, 8, 40):
        d1, d2, counts = rng.random(n), rng.random(n + 2), rng.integers(0, 5, (n, n + 2))
        for enough in (1, 40, counts.sum()):
            upto, sums = ann.reach(d1, d2, counts, enough), d1[:, None] + d2
            order = np.argsort(sums.ravel())
            need = sums.ravel()[order][np.searchsorted(np.cumsum(counts.ravel()[order]), enough)]
            assert counts[sums <= upto].sum() >= min(enough, counts.sum()) or upto >= need
            # a run's cells may come early, never so many that the order doesn't matter
            assert counts[sums <= upto].sum() <= enough + ann.RUN * counts.max() * (n + 1)
        assert ann.reach(d1, d2, counts, counts.sum() + 1) == np.inf


@pytest.mark.parametrize(("folder", "most"), [("sf0.01", 0.5), ("sf0.1", 0.4)])
def test_recall_at_the_share_visited(spark, folder, most):
    """Against brute force over all vectors of the table, with the share of entries that queries really visit."""
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect() if r["embedding"]]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    seen: list[float] = []
    got = defaultdict(set)
    for r in ann.search(table.withColumn("rid", F.lit("a")).withColumn("upto", F.lit(1)), "vec_id % 20 = 0").collect():
        got[r["query_id"]].add(r["vec_id"])
    k, half = min(ann.MOST_CENTROIDS, len(x) // 2), x.shape[1] // 2
    books = [ann._centroids(x[:, s], k) for s in (slice(None, half), slice(half, None))]
    at = [((c**2).sum(1) - 2 * x[:, s] @ c.T).argmin(1) for c, s in zip(books, (slice(None, half), slice(half, None)), strict=True)]
    counts = np.zeros((k, k), int)
    np.add.at(counts, tuple(at), 1)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits, total = hits + len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())), total + 20
        d = -books[0] @ x[q, :half], -books[1] @ x[q, half:]
        upto = ann.reach(*d, counts, int(np.ceil(0.3 * len(x))))
        seen.append(counts[d[0][:, None] + d[1] <= upto].sum() / len(x))
    assert hits / total >= 0.9 and np.mean(seen) < most


def test_quality_finds_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op10_quality(spark, folder).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_of_odd_rows(docs):
    rows = quality.score_documents(docs).collect()
    assert len(rows) == len(fixture_rows()) and all(r["probability"] == 0 and not r["kept"] for r in rows if r["n_words"] == 0)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_accuracies_of_labellers_are_estimated():
    rng = np.random.default_rng(0)
    truth, accuracy = rng.random(5000) < 0.7, np.array([0.95, 0.9, 0.8, 0.7, 0.9, 0.85, 0.75, 0.9])
    right = rng.random((5000, 8)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((5000, 8)) < 0.8)
    posterior, found, prior = quality.estimate(Counter(quality.pattern_number(votes).tolist()))
    assert np.abs(found - accuracy).max() < 0.05 and abs(prior - 0.7) < 0.05
    assert ((posterior[quality.pattern_number(votes)] > 0.5) == truth).mean() > 0.93


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert quality.score_documents(empty).count() == 0
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0
    for f in (quality.keep_good, exact_dedup.drop_exact_copies, near_dedup.drop_near_copies, mixing.repeat_taken):
        assert f(empty).columns == empty.columns and f(empty).count() == 0


def test_staged_tables_are_deleted(spark, tmp_path):
    from shelfloom.llm import storage

    storage.release(spark)
    one, two = (storage.staged(spark.range(5), name) for name in ("one", "two"))
    storage.discard(one)
    assert two.count() == 5 and storage.release(spark) == 1 and storage.release(spark) == 0
    with pytest.raises(Exception, match="two"):
        spark.read.parquet(two.inputFiles()[0]).count()


def plain_votes(text: str | None) -> list[int]:
    """Votes by definition, word after word."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
    n = len(words)
    if not n:
        return [0] * 8
    stop = {w.encode() for t in html_text.STOP_WORDS.values() for w in t.split()}
    symbol, again = set(b"#$%&*!@^~|=+<>_\\{}"), [k > 0 and words[k].lower() == words[k - 1].lower() for k in range(n)]
    share = lambda f: sum(bool(f(w, r)) for w, r in zip(words, again, strict=True)) / n
    symbols = share(lambda w, r: w[-1] in symbol and (len(w) == 1 or w[-2] in symbol))
    capitals = share(lambda w, r: len(w) > 1 and w[:2].isalpha() and w[:2].isupper())
    stops, marks = share(lambda w, r: w.lower() in stop and not r), share(lambda w, r: w[-1:] in b".," and not r)
    letters, variety = sum(map(len, words)) / n, len({w.lower() for w in words}) / n**0.8
    return [
        -(symbols > 0.1), -(capitals > 0.25 and n > 15), -(sum(again) / n > 0.12 and n > 5), -(share(lambda w, r: w == b"|") > 0.08), -1 if stops < 0.04 and n > 15 else int(stops > 0.12),
        -1 if n > 40 and (marks > 0.7 or marks < 0.005) else int(0.02 < marks < 0.4 and n > 15), -(variety < 0.3 and n > 30), -((letters < 1.8 or letters > 16) and n > 15),
    ]


def test_quality_equals_brute_force(spark):
    """Votes word by word, estimation document by document, and scores as plain sums over words."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9000 + k, t) for k, t in enumerate([None, "", " \n", "one", "| " * 50, "A B " * 30, "é È ÀB", "same same same same same same same", "x" * 5000, "#$ ok %% !! " * 9])]
    votes = np.array([plain_votes(t) for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "probability": F.lit(7), "label": F.lit(None).cast("string")})
    counts = quality.pattern_counts(docs)
    assert counts == Counter(quality.pattern_number(votes).tolist())
    accuracy, prior = np.full(8, 0.8), 0.7
    for _ in range(100):
        good = []
        for v in votes:
            odds = prior / (1 - prior) * np.prod([(a / (1 - a)) ** x for a, x in zip(accuracy, v, strict=True)])
            good.append(odds / (1 + odds))
        good = np.array(good)
        for k in range(8):
            right = sum(g if v[k] == 1 else 1 - g for g, v in zip(good, votes, strict=True) if v[k])
            accuracy[k] = min(max((right + 0.8) / ((votes[:, k] != 0).sum() + 1), 0.55), 0.99)
        prior = min(max((good.sum() + 1) / (len(votes) + 2), 0.05), 0.95)
    posterior, found, p = quality.estimate(counts)
    assert np.allclose(found, accuracy) and np.isclose(p, prior)
    weights = quality.fit(docs)
    scored = {r["doc_id"]: r for r in quality.score_documents(docs).collect()}
    low, mask = lambda w: int(quality.Words([w]).number[0]), (1 << quality.PLACES_BITS) - 1
    for d, text in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
        x = 0.0
        for k, w in enumerate(words):
            ends = [w[0], w[min(1, len(w) - 1)], w[-1], w[max(len(w) - 2, 0)]]
            with np.errstate(over="ignore"):
                shape = int(quality.mixed(sum(quality.CLASS[[e]] * quality.PLACES[j] for j, e in enumerate(ends)))[0])
            x += weights[low(w) & mask] + weights[shape & mask] + weights[int(k > 0 and w.lower() == words[k - 1].lower())]
        x = x / (len(words) + quality.EXTRA) + weights[-1]
        want = 1 / (1 + np.exp(-np.clip(x, -30, 30))) if words else 0.0
        r = scored[d]
        assert r["n_words"] == len(words) and abs(r["probability"] - want) < 2e-3 and r["kept"] == (r["probability"] >= 0.5)
