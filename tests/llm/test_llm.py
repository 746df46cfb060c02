import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing, subjects, tokenizer
from tidemark.llm.claims import claims_of
from tidemark.llm.packing import Packing, pack
from tidemark.llm.survivors import normalised, pivot_back, survivors, trust_votes, unpivot

# --- survivors ---

SCHEMA = "g string, field_name string, id long, value string, rank int, at int, keep string, vote string"


def survive(spark, rows, ranked=True):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    order = F.struct(-F.col("rank"), F.col("at"), -F.col("id"))
    vote = None if ranked else trust_votes(F.lit(1.0) / F.col("rank"), F.lit(10) - F.col("at"), F.lit(10))
    out = survivors(df, group=["g", "field_name"], candidate="id", value=normalised("value"), vote=vote, order=F.when(F.col("rank").isNotNull(), order), keep=["id", "value"])
    return sorted((r.g, r.field_name, r.id) for r in out.collect())


def test_ranked_votes_and_groups_of_one(spark):
    rows = [("a", "nav", 1, "1.0", 2, 9), ("a", "nav", 2, "1", 1, 1), ("a", "nav", 3, "unknown", 1, 5), ("b", "nav", 4, "1", 1, 1), ("b", "nav", 4, "1", 1, 1), ("c", "nav", 5, None, 1, 1), ("c", "nav", 6, " -- ", 1, 1), ("d", "nav", 7, "x", None, 1), ("d", "nav", 8, "y", 3, 1), (None, "nav", 9, "y", 3, 1), ("e", None, 9, "y", 3, 1)]
    assert survive(spark, rows) == [("a", "nav", 2), ("d", "nav", 8)]
    assert survive(spark, []) == []


def test_summed_votes_let_agreeing_sources_win(spark):
    rows = [("a", "fee", 1, "0.5", 1, 10), ("a", "fee", 2, "0.60", 2, 10), ("a", "fee", 3, "0.6", 2, 9), ("a", "fee", 3, "0.6", 2, 9), ("a", "fee", 4, "0.600", 2, 10)]
    assert survive(spark, rows, ranked=False) == [("a", "fee", 2)]
    assert survive(spark, rows) == [("a", "fee", 1)]
    assert survive(spark, rows[:1] + rows[2:4], ranked=False) == [("a", "fee", 1)]


def test_places_keep_the_strict_order_of_large_groups(spark):
    r = random.Random(3)
    rows = [("a", "f", i, r.choice("uvwxyz"), r.randint(1, 3), r.randint(0, 400)) for i in range(3000)]
    for some in (rows, [x for x in rows if x[4] == 3], rows[:600]):
        best = max(some, key=lambda x: (-x[4], x[5], -x[2]))
        assert survive(spark, some) == [("a", "f", best[2])]


def test_ties_and_notations(spark):
    same = [("a", "f", i, v, 1, 1) for i, v in [(3, "x"), (1, "y"), (2, "z")]]
    assert survive(spark, same) == [("a", "f", 1)]
    texts = spark.createDataFrame([("tracking_index", "SH900001"), ("tracking_index", "９００００１.SZ"), ("fund_company", " Alden  Fund Mgmt"), ("fund_company", "alden fund MANAGEMENT"), ("nav", "1,000.50"), ("nav", "1.0005E+3"), ("nav", "N/A"), ("x", "")], "field_name string, value string")
    got = [r.n for r in texts.select(normalised("value").alias("n")).collect()]
    assert got[0] == got[1] == "900001" and got[2] == got[3] and got[4] == got[5] == "1000.5" and got[6] is None and got[7] is None


def test_unpivot_and_pivot_back(spark):
    wide = spark.createDataFrame([(1, "a", None), (2, None, "b")], "id long, x string, y string")
    long = unpivot(wide, ["id"], ["x", "y"])
    assert long.count() == 4
    assert sorted((r.id, r.x, r.y) for r in pivot_back(long, ["id"], ["x", "y"]).collect()) == [(1, "a", None), (2, None, "b")]


# --- tokenizer ---

TEXTS = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a b", "a  b", "a   b ", "\n\n[0001] It's  a\ttest\r\n\r\nof 12 things, isn't it?", "x \n y\n\n z", "一种具有载波频率的基站装置，包括12个（345）信道。\n\n权利要求书\n\n1. 一种", "<|endoftext|> is <|endoftext|>text",
    "🙂 a🙂b ​ 　 c", "\x1c d\x1f e\x85f g", "gtgcagggatacagctgatcgtcgattttgcccacccacttccccatgaaaagcaggtag 60\ngaggagatgg", "dü ́ é�", "ab" * 3000, "word " * 3000, "\0 \0a", "   x", "a  b", "1. 一种，2。三 四",
]


@pytest.fixture(scope="module")
def definition():
    with open(tokenizer.TOKENIZER_FILE, encoding="utf-8") as f:
        return f.read()


def texts(seed, n=400):
    r = random.Random(seed)
    parts = ["a", "word", "'s", "12", " ", "  ", "\n", "\n\n", "\t", "，", "。", "一种", "é", "🙂", "[0001]", " ", "　", "\r\n", "<|endoftext|>", ".", " ", "\x1d", "（", "３"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_pieces_give_the_ids_of_the_whole_text(definition):
    whole = tokenizer.load_tokenizer(definition)
    encoder, decoder = tokenizer.PieceEncoder(definition, limit=300), tokenizer.ByteDecoder(definition)
    for batch in (TEXTS, texts(1), texts(2), TEXTS + [None]):
        want = [e.ids for e in whole.encode_batch([t or "" for t in batch], add_special_tokens=False)]
        got = encoder.encode(batch).to_pylist()
        assert got == want
        assert encoder.sizes_of(batch).tolist() == [len(x) for x in want]
        assert [decoder.text(x) for x in got] == [t or "" for t in batch]


def test_offsets_are_those_of_the_library(definition):
    whole, decoder = tokenizer.load_tokenizer(definition), tokenizer.ByteDecoder(definition)
    for t in TEXTS + texts(3):
        e = whole.encode(t, add_special_tokens=False)
        assert decoder.offsets(e.ids) == e.offsets


def test_every_document_has_ids(spark):
    df = spark.createDataFrame([(1, "a b", "clash"), (2, None, "x"), (3, "", "x"), (1, "a b", "x")], "doc_id long, text string, ids string")
    assert sorted((r.doc_id, len(r.ids)) for r in tokenizer.token_ids(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert sorted((r.doc_id, r.n_tokens) for r in tokenizer.token_sizes(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert all(r.exact for r in tokenizer.round_trips(df).collect())
    assert tokenizer.token_ids(df.limit(0)).count() == 0


def test_slices_bound_the_bytes_and_keep_the_rows():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 0, 30, 7, 7, 7)] + [None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = list(tokenizer.text_slices(iter([batch, batch.slice(0, 0)]), most_bytes=14))
    assert [v for p in parts for v in p.column(1).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [2, 1, 2, 3]


# --- packing ---

@pytest.mark.parametrize("capacities", [[512], [512, 2048, 8192]])
def test_plans_hold_every_item_once_and_stay_within_capacity(capacities):
    r = random.Random(4)
    for n in (0, 1, 3, 300):
        items = [min(r.choice([r.randint(0, capacities[-1]), r.randint(0, 300), 40]), capacities[-1]) for _ in range(n)]
        histogram = defaultdict(int)
        for i in items:
            histogram[i] += 1
        bins = defaultdict(list)
        for size, first, until, container, each, capacity, filled in Packing(histogram, capacities).assignments():
            for rank in range(first, until):
                bins[container + (rank - first) // each].append((size, capacity, filled))
        assert sorted(s for b in bins.values() for s, *_ in b) == sorted(items)
        for b in bins.values():
            assert len({x[1:] for x in b}) == 1 and sum(x[0] for x in b) == b[0][2] <= b[0][1] in capacities


def naive_best_fit(items, capacity):
    rooms = []
    for i in sorted(items, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= i]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= i
        else:
            rooms.append(capacity - i)
    return len(rooms)


def test_as_good_as_best_fit_decreasing_one_by_one():
    r = random.Random(6)
    for _ in range(10):
        items = [r.randint(1, 100) for _ in range(200)]
        histogram = {s: items.count(s) for s in set(items)}
        assert Packing(histogram, [100]).total <= naive_best_fit(items, 100) + 1


def test_the_least_cost_capacity_is_opened():
    plan = Packing({60: 2, 30: 1, 10: 1}, [64, 100])
    assert sorted(g[2:] for g in plan.groups) == [(64, 60), (100, 100)]  # one item of 60 is completed to 100, the other stays alone
    assert Packing({60: 1}, [64, 100]).groups == [(0, 1, 64, 60)]
    assert Packing({60: 2, 40: 2}, [64, 128]).space() == 256 and Packing({60: 2, 40: 2}, [64, 128], overhead=1000).total == 2
    r = random.Random(1)
    for _ in range(5):
        histogram = {s: r.randint(1, 9) for s in r.sample(range(1, 257), 60)}
        assert Packing(histogram, [64, 128, 256]).space() <= Packing(histogram, [256]).space()


def test_hot_sizes_are_ranked_in_buckets(spark):
    df = spark.range(500).selectExpr("'p' AS packing", "id AS doc_id", "0 AS piece_no", "IF(id % 5 = 0, 9, 4) AS n_tokens")
    ranked = packing._ranked(df, {("p", 9): 100, ("p", 4): 400}, "doc_id", at_once=150).collect()
    for size, n in ((9, 100), (4, 400)):
        assert sorted(x._rank for x in ranked if x.n_tokens == size) == list(range(n))


def test_packing_documents(spark):
    sizes = [0, 0, None, 5, 20, 20, 20, 33, 64, 64, 65, 700]
    df = spark.createDataFrame([(i, s, 1, 1) for i, s in enumerate(sizes)], "doc_id long, n_tokens long, _bucket int, container_id int")
    rows = pack(df, [64, 16]).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.piece_no, r.first_token, r.n_tokens))
    for i, s in enumerate(sizes):
        own = sorted(parts[i])
        assert sum(p[2] for p in own) == (s or 0) and len(own) == max(1, -(-(s or 0) // 64))
        assert [p[1] for p in own] == [64 * k for k in range(len(own))]
    for c in {r.container_id for r in rows}:
        own = [r for r in rows if r.container_id == c]
        assert sum(r.n_tokens for r in own) == own[0].filled_tokens <= own[0].capacity_tokens in (16, 64)
    assert pack(df.limit(0), [64]).count() == 0


# --- subjects ---

def test_claims_are_found_in_damaged_texts():
    assert claims_of(None) == [] and claims_of("") == [] and claims_of("Text folgt.") == []
    plain = "Pump\n\nAbstract\nSee example 12. It pumps.\n\nWhat is claimed is:\n\n1. A pump, comprising a valve.\n\n2. The pump of claim 1.\nSEQUENCE LISTING\nacgt 60"
    assert claims_of(plain) == ["A pump, comprising a valve.", "The pump of claim 1."]
    assert claims_of(plain.replace("\n", "\r\n")) == claims_of(plain)
    assert claims_of(plain.replace("comprising", "com-\nprising").replace("What is", "What-\n is")) == claims_of(plain)
    assert len(claims_of("水泵\n\n权利要求书\n\n1. 一种水泵。\n\n2. 根据权利要求1所述的水泵。")) == 2
    assert len(claims_of("Pompe\n\nRevendications\n\n1. Pompe avec valve.\n\n2. Pompe selon la revendication 1.\n\n3. Pompe selon l'une des revendications 1 à 2.\n\n4. Pompe.")) == 4
    assert claims_of("[0001] Text.\n\n1. Vorrichtung mit Ventil.\n\n2. Verfahren.") == ["Vorrichtung mit Ventil.", "Verfahren."]


def test_claims_before_the_heading_are_kept():
    first, second = "1. A seed drill, comprising a grain tank.", "2. The seed drill of claim 1, wherein the tank is made of steel."
    text = f"Seed drill\n\nIt sows; see example\n7. The tank is then filled.\n\n{second}\n\nSummary\n\n{first}\n\nIt has been found to work.\n\nWhat is claimed is:\n\nIn one embodiment, a tyre is used.\n\n3. The seed drill of claim 2, wherein the tyre has a tread."
    wanted = {"A seed drill, comprising a grain tank.", "The seed drill of claim 1, wherein the tank is made of steel.", "The seed drill of claim 2, wherein the tyre has a tread."}
    assert set(claims_of(text)) == wanted
    assert set(claims_of(text.replace("\n\n", "\n"))) == wanted
    assert set(claims_of("1. 一种播种机，包括粮箱。\n\n本发明涉及轮胎。\n\n权利要求书\n\n2. 根据权利要求1所述的播种机。")) == {"一种播种机，包括粮箱。", "根据权利要求1所述的播种机。"}
    assert claims_of("1. Field of the invention\n\nIt pumps.\n\nWhat is claimed is:\n\n1. A pump, comprising a valve.\n\n2. The pump of claim 1.") == ["A pump, comprising a valve.", "The pump of claim 1."]


def test_claims_whose_number_is_not_first_are_kept():
    lines = ["1. A car, comprising a wheel.", "The above-mentioned of 2. A method of steering, using the car as claimed in claim 1.", "method A 3. of braking, using the car as claimed in claim 1.", "4\n. The car of claim 1, comprising:\n\na hub; and\n\na rim.", "5.\nThe car of claim 4."]
    wanted = ["A car, comprising a wheel.", "A method of steering, using the car as claimed in claim 1.", "method A of braking, using the car as claimed in claim 1.", "The car of claim 1, comprising:\n\na hub; and\n\na rim.", "The car of claim 4."]
    assert claims_of("Car\n\nWhat is claimed is:\n\n" + "\n\n".join(lines) + "\n\nAs shown in FIG. 3, the hub turns.\n\nThe hub is old; see example 12. The rim is new.") == wanted
    assert claims_of("Car 1. A car, comprising a wheel. It is then checked. Summary 2. The car of claim 1. What is claimed is: 3. The car of claim 2.") == ["A car, comprising a wheel.", "The car of claim 1.", "The car of claim 2."]
    assert claims_of("Pompe\n\nRevendications\n\n1. Pompe avec valve.\n\nLadite 2. Pompe selon la revendication 1.") == ["Pompe avec valve.", "Pompe selon la revendication 1."]


def corpus(seed=1, n=300):
    r = random.Random(seed)
    words = {"medicine": ["stent", "bone implant", "dosing the patient", "catheter tip"], "sport": ["racket string", "goal post", "striking the ball", "ski boot"], "energy": ["turbine blade", "fuel rod", "charging the battery", "solar panel"]}
    docs, truth = [], {}
    for i in range(n):
        own = r.sample(sorted(words), 1 if r.random() < 0.75 else 2)
        other = r.choice([w for s in words if s not in own for w in words[s]])
        claims = [f"{k}. A device with {r.choice(words[own[k % len(own)]])} and {r.choice(words[own[k % len(own)]])}." for k in range(1, 9)]
        docs.append((i, f"Device\n\n[0001] The word {other} is used in passing.\n\nWhat is claimed is:\n\n" + "\n\n".join(claims), "clash"))
        truth[i] = set(own)
    return docs, truth, sorted(words)


def test_subjects_on_held_out_documents(spark):
    docs, truth, names = corpus()
    extra = [(1000, None, "x"), (1001, " ", "x"), (1002, "Text folgt.", "x")]
    labels = [(i, s, "r1") for i in range(0, 300, 4) for s in truth[i]] + [(4, names[0], None), (9999, names[0], "r1"), (8, "no such subject", "r2")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, marks string")
    found = defaultdict(set)
    for r in subjects.subject_posteriors(d, spark.createDataFrame(labels, "doc_id long, subject string, reviewer string"), names, bits=14).collect():
        found[r.doc_id].add(r.subject)
    held = [i for i in truth if i % 4]
    assert sum(found[i] == truth[i] for i in held) >= 0.95 * len(held)
    assert not {1000, 1001, 1002} & {i for i, s in found.items() if s}


def test_without_labels_or_documents(spark):
    docs, _, names = corpus(n=5)
    d = spark.createDataFrame(docs, "doc_id long, text string, marks string")
    none = spark.createDataFrame([], "doc_id long, subject string, reviewer string")
    assert subjects.subject_posteriors(d, none, names, bits=10).count() == 0
    assert subjects.subject_posteriors(d.limit(0), none, names, bits=10).count() == 0
