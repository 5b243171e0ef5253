"""Every operator on a table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from meshwright.llm import chat, chroma, decontam, hpylm, interleave, langid, minhash, pieces, pii, queries, token_store

EN = "the quick fox and the lazy dog went over that hill with all of their friends on a sunny day "
LONG = EN * 400
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, score string"


def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    out = [(None, "no id here at all", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, "  \n ", "en", "a"), (4, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "one two", "en", "a"), (6, "one two", "en", "a"), (7, "ONE  two", "en", "c"), (8, "12345 !!", "en", "c")]
    for i in range(9, 60):
        base = [word() for _ in range(40)]
        out.append((i, " ".join(base), "en", "a"))
        if i % 5 == 0:
            out.append((i + 100, " ".join(base + ["extra"]), "en", "a"))
            out.append((i + 200, " ".join(base + ["more", "again"]), "en", "a"))
    return [(i, t, lang, s, len(t) if t else None, True, "x", "y") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_frames(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = token_store.write_token_files(docs, P.path("word_bpe_49k.json"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_token_files(manifest).collect())
    want, at = [], 0
    for i, t, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    some = token_store.fetch_documents(manifest, docs.where("doc_id IN (4, 6)").select("doc_id")).collect()
    assert sorted(r["doc_id"] for r in some) == [4, 6, 6]
    assert token_store.read_token_files(token_store.write_token_files(none, P.path("word_bpe_49k.json"))).count() == 0


def test_reader_opens_only_wanted_frames_and_checks_them():
    out = io.BytesIO()
    w = token_store.FrameWriter(out, 2, 64)
    for i in range(50):
        w.add(i, np.arange(20, dtype="<u2").tobytes())
    w.close()
    raw = bytearray(out.getvalue())
    reader = token_store.FrameReader(io.BytesIO(raw), len(raw))
    assert len(reader.get(7)[0]) == 20 and reader.decompressed == 1
    raw[8] ^= 255
    with pytest.raises(Exception):
        token_store.FrameReader(io.BytesIO(raw), len(raw)).get(0)


def test_words_are_the_librarys():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_store.WordEncoder(P.path("word_bpe_49k.json"), 50)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aAéÉßİıʼnσΣ'’s tmé \x1c\x85\xa0\n.,!|<>endoftx012漢🙂\x01") for _ in range(rnd.randint(0, 50))) for _ in range(600)]
    assert all(np.frombuffer(g, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids for t, g in zip(texts, own.encode(texts), strict=True))


def test_interleave(docs, none):
    got = interleave.interleave(docs, 8, range_rows=8).toPandas()
    assert len(got) == len(rows()) and sorted(got.position) == list(range(len(got)))
    size = got.groupby("shard").size()
    assert size.max() - size.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert interleave.interleave(none).count() == 0
    assert sorted(interleave.interleave(docs.limit(3), 8).toPandas().shard) == [0, 1, 2]


def test_chat_trees(spark):
    said = ["</s>[INST] ok [/INST]", "␛1<s>␛", None, "<<TURN x>>[INST", ""]
    rows_ = [(7, i, ["user", "assistant", "a<b>c", None, "assistant"][i], t) for i, t in enumerate(said)] + [(None, 0, "user", "x"), (8, 0, "user", "same"), (8, 0, "user", "same")]
    made = chat.format_trees(chat.as_tree(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")))
    back = {r["conv_id"]: r for r in made.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [(x["role"], x["text"]) for x in back[7]["t"]] == [(r or "", t or "") for _, _, r, t in rows_[:5]] and back[7]["l"] == said[1]
    assert len(back[8]["t"]) == 2 and len(back[None]["t"]) == 1
    tree = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 3, 9.0), (1, 5, 3, 3.0), (2, 1, 2, 0.0), (2, 2, 1, 0.0)], "conv_id long, node long, parent long, score double")
    every = {(r["leaf"], r["branch_rank"]): r["d"] for r in chat.paths(tree, None).groupBy("leaf", "branch_rank").agg(F.expr("transform(array_sort(collect_list(struct(depth, node))), x -> x.node)").alias("d")).collect()}
    assert every == {(4, 1): [1, 3, 4], (2, 2): [1, 2], (5, 3): [1, 3, 5]}


def test_pieces_are_the_librarys(docs, none):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), pieces.PieceModel(P.path("piece_bpe_32k.model"))
    rnd = random.Random(3)
    texts = [LONG[:3000], "x" * 700] + ["".join(rnd.choice("aAéthing \n▁漢🙂\x01  ,.'0") for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    assert [i.tolist() for i in own.encode(texts)] == lib.encode(texts)
    got = pieces.encode_table(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows()) and all(r["round_trip"] for r in got)
    assert pieces.encode_table(none, P.path("piece_bpe_32k.model")).count() == 0


def test_language(spark, docs, none):
    de = "der und die das ist nicht mit sich auch für eine zu haben werden "
    train = [(i, (EN if i % 2 else de)[i % 7 :] * (1 + i % 3), "en" if i % 2 else "de") for i in range(80)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), 30)
    assert model.predict([EN[5:50], de[3:40], None, "", "123"])[0] == ["en", "de", "und", "und", "und"]
    kept = langid.keep_spoken(docs, model)
    assert kept.schema == docs.schema and {8, 1, 2} & {r["doc_id"] for r in kept.collect()} == set()
    assert langid.predict(docs, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_sparse_length_bins_keep_a_floor():
    rnd = random.Random(7)
    words = {"en": EN.split(), "de": "der und die das ist nicht mit sich auch für eine zu haben werden".split()}
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    train = [(say(lang, n), lang) for lang in words for n in [3, 5, *[20] * 15, *[60] * 15, *[200] * 15, 5000]]  # few short, two of 16,384 or more
    model = langid.fit_rows([t for t, _ in train], [lang for _, lang in train])
    assert (model.floors > 0).all() and (np.diff(model.floors) >= 0).all()
    junk = ["".join(rnd.choice("qxzjvkwy ") for _ in range(n)) for n in (40, 300, 2000, 20000)]
    assert model.predict(junk)[2] == [True] * len(junk)
    clean = [(say(lang, n), lang) for lang in words for n in (3, 5, 20, 200, 5000)]
    got, _, rejected = model.predict([t for t, _ in clean])
    assert got == [lang for _, lang in clean] and not any(rejected)


def test_no_language_is_left_out(spark):
    train = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)} " * 9, f"l{i:03}") for i in range(230)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    assert langid.fit(df, 30).langs == [lang for _, _, lang in train]
    assert len(langid.fit(df, 30, max_rows=100).langs) == 230  # fewer rows each, at least one


def brute_components(items, percent):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets, par = {}, {}
    for i, t, *_ in items:
        w = (t or "").encode().translate(table).split()
        if i is not None:
            sets[i], par[i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()), i

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs, none):
    want = brute_components(rows(), 85)
    got = minhash.near_duplicates(docs, 5, 85).collect()
    assert len(got) == len(rows()) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    one = minhash.keep_one(docs, 5, 80)
    ids = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({c for i, (_, c) in brute_components(rows(), 80).items()}) and None in ids
    assert minhash.near_duplicates(none).count() == 0


def test_rest_round_links_across_blocks(spark):
    rnd = random.Random(8)
    base = [str(rnd.randint(0, 10**6)) for _ in range(60)]
    items = []
    for i in range(150):  # a chain of drifting copies: far ends are unlike, neighbours alike
        base = base[1:] + [str(rnd.randint(0, 10**6))]
        items.append((i, " ".join(base)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(items, "doc_id long, text string"), 5, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(items, 85).items()}


def test_language_model(docs, none):
    got = hpylm.score(docs).toPandas()
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    count, toks = defaultdict(int), []
    for i, t, *_ in rows():
        w = (t or "").encode().translate(table).split() + [None]
        toks.append((i, w))
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            for x in w:
                count[x] += 1
    n, v = sum(count.values()), len(count)
    want = sorted((i or -1, len(w), round(sum(np.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in toks)
    assert sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.n_tokens, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert set(got.train_tokens) == {n} and hpylm.score(none).count() == 0


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 8 * 16, 60))
    p = 10.0 ** hpylm.train(codes, rng.integers(1, 300, len(codes)), contexts=8, dishes=16)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_decontamination(spark, docs, none):
    rnd = random.Random(2)
    w = lambda k: " ".join("".join(rnd.choice("abcé") for _ in range(2)) for _ in range(k))
    items = [(1, w(14)), (2, w(14)), (10, "short item"), (3, None), (4, "!!"), (5, "solo")]
    items.append((6, items[0][1]))
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    texts = ["".join(c.upper() if c.isascii() else c for c in items[0][1]), "x-" + items[1][1].replace(" ", "; ") + " " + w(30), w(500), "a SHORT\nitem, solo", None, "", items[0][1][:-12]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        words, hit, found = pat.findall(low(t or "")), set(), set()
        for k, x in items:
            y = pat.findall(low(x or ""))
            m = min(10, len(y))
            for a in range(len(y) - m + 1 if m else 0):
                for b in range(len(words) - m + 1):
                    if words[b : b + m] == y[a : a + m]:
                        hit |= set(range(b, b + m))
                        found.add(str(k))
        assert got[i] == (len(words), len(hit), sorted(found))
    assert decontam.keep_clean(docs, bench.limit(0)).count() == len(rows()) and decontam.scan(none, bench).count() == 0
    small = decontam.Matcher(bench, bound=1)  # beyond the bound: blocks come from files
    assert small.files and small.search([items[0][1].encode()])[0][1] == 14


def test_personal_data(docs, none):
    text = "mail a.b@x.org. ip 10.0.0.300 1.2.3.4 card 4111 1111 1111 1111, +1 (555) 010-9999 x" + "9" * 5000
    assert pii.joined(pii.base_spans(text)) == "email:5:14,ip:30:37,card:43:62,phone:64:81"
    got = pii.find(docs).collect()
    assert len(got) == len(rows()) and all(r["spans"] == "" for r in got)
    assert pii.redact(docs).schema == docs.schema and pii.find(none).count() == 0
    (base, whole), (no, _) = pii.all_spans(["call (555) 123-4567 now", None], pii.trained())
    assert base == [] and whole == [(5, 19, "phone")] and no == []


def test_chroma(spark):
    rng = np.random.default_rng(1)
    notes = rng.standard_normal(64).tolist()
    (tune,) = chroma.play([notes])
    late, noisy = tune[4 * chroma.HOP :], tune + 0.05 * rng.standard_normal(len(tune)).astype(np.float32)
    other = chroma.play([rng.standard_normal(64).tolist()])[0]
    media = [(0, tune), (1, late), (2, noisy), (3, other), (4, tune), (5, None), (6, tune[:10]), (7, np.full(9000, np.nan))]
    df = spark.createDataFrame([(i, None if s is None else [float(x) for x in s]) for i, s in media], "id long, samples array<float>")
    prints = chroma.fingerprint_table(df).cache()
    found = {(r["id"], r["query_id"]): r["offset"] for r in chroma.search(prints, prints.where("id = 0")).collect()}
    assert found.keys() == {(0, 0), (1, 0), (2, 0), (4, 0)} and found[1, 0] == -4
    assert {r["id"]: r["class_id"] for r in chroma.classes(prints).collect()}[4] == 0


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
