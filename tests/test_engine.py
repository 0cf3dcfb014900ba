"""Golden values, properties and round trips of the engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from kinforge.config import EngineConfig
from kinforge.functions import comparators as C
from kinforge.functions import names as N
from kinforge.functions import native as V
from kinforge.functions import tables as T
from kinforge.operators import decision as D
from kinforge.operators import evaluate as E
from kinforge.operators import learning as L
from kinforge.operators import validate as Z
from kinforge.sources import io

SF = "/root/testdata/sf0.001"
WORDS = N.Vocabulary({w: -8.0 for w in "cardiology safe care mountain view".split()})


@pytest.mark.parametrize(("raw", "core", "domain"), [
    ("cardi0logysafecare.com", "cardiology safe care", 1), ("4528mountainview.com", "4528 mountain view", 1), ("Team2000 Inc", "team2000", 0), ("Shop24x7 Retail", "shop24x7 retail", 0),
    ("Sirius", "sirius", 0), ("Costco", "costco", 0), ("telecom", "telecom", 0), ("PC Club SAS", "pc club", 0), ("Sel Water Pvt Ltd", "sel water", 0), (None, "", 0), ("", "", 0),
])
def test_names(raw, core, domain):
    r = N.normalize_name(raw, WORDS)
    assert (r["name_core"], r["is_domain"]) == (core, domain)


def test_addresses():
    a = N.normalize_address("19 R DE LA LIBERTE, LILLE, Hauts-de-France", "france")
    assert a["admin"] == "zzfrhautsdefrance" and a["addr_words"] == ["liberte", "lille"] and a["first_num"] == "19"
    assert N.normalize_address("59000 LILLE", "france")["postal"] == "59000"
    assert N.normalize_address("71st 1er 2eme 3e", "us")["nums"] == ["71", "1", "2", "3"]
    assert N.normalize_address(None)["addr_norm"] == ""
    r = N.normalize_address("12-14 Main Street", "us")
    assert r["ranges"] == [{"lo": 12, "hi": 14}] and "1214" in r["nums"]


def test_tables():
    o = T.ordinals()
    assert (o["first"], o["ninth"], o["twentieth"], o["forty second"]) == ("1", "9", "20", "42") and len(o) == 99 - 0
    assert T.US_STATES["texas"] == "tx" and T.FRENCH_DEPARTMENTS["nord"] == "hauts de france"
    assert all(len(a) == 1 for a in T.accents()[0])


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_comparators():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert C.lcs(a, b) == slow_lcs(a, b)
    assert C.token_set("a b c", "b a") == 100 and C.token_sort("b a", "a b") == 100 and C.partial("abc", "xxabcx") == 100
    assert C.ratio("", "") == 100 and C.ratio("a", "") == 0 and C.token_set("", "a") == 0
    assert round(C.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611


def test_native_text(spark):
    df = spark.createDataFrame([("l.l.c. x", "été Straße", "71st 1er 2eme 3e", "1-3 a, 59000"), (None, None, None, None)], "a string, b string, c string, d string")
    rows = df.select(V.dotted(F.col("a")), V.fold(F.col("b")), V.ordinal_strip(F.col("c")), V.postal(F.col("d")), V.script(F.col("b"))).collect()
    assert tuple(rows[0]) == ("llcx", "ete Strasse", "71 1 2 3", "59000", 1)


def test_full_normalize_learns_its_tables(spark):
    """Glued names ending in .com (orders with k = 7) come apart into their owner's words; Indic words are learned."""
    from kinforge.plans import normalising as Q

    rows = {r.entity_id: r for r in Q.full_normalize(spark, SF).select("entity_id", "name_core").collect()}
    glued = Q.X.records(spark, SF).where("owner_id is not null and business_name like '%.com'").select("entity_id", "owner_id").collect()
    assert glued and all(rows[g.entity_id].name_core == rows[g.owner_id].name_core and " " in rows[g.owner_id].name_core for g in glued)
    names = [("S1-1", "Ram Traders", None), ("S1-2", "Ram Foods Ltd", None), ("S2-1", "राम ट्रेडर्स", "S1-1"), ("S3-1", "राम फूड्स", "S1-2")]
    logp, translit = Q.learned(spark.createDataFrame(names, "entity_id string, business_name string, owner_id string"))
    assert set(logp) == {"ram"} and translit == {"राम": "ram"}


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, s23_id string, country string, addr_empty boolean, label int, prob double")


def test_expected_f_examples(spark):
    one = D.expected_f(pairs_of(spark, [("a", "x", "us", False, 1, 0.55)])).collect()
    assert [r.selected for r in one] == [True]
    two = D.expected_f(pairs_of(spark, [("a", "x", "us", False, 1, 0.98), ("a", "y", "us", False, 0, 0.55)])).collect()
    assert {r.s23_id for r in two if r.selected} == {"x"}


def test_ladder_without_deltas_is_threshold_and_one_owner_holds(spark):
    r = random.Random(3)
    rows = [(f"S1-{r.randint(0, 20)}", f"S2-{i}", "us", False, r.randint(0, 1), r.randint(0, 100) / 100) for i in range(200)]
    rows += [(f"S1-{r.randint(0, 20)}", f"S2-{i}", "us", False, 0, r.randint(0, 100) / 100) for i in range(0, 200, 2)]
    df = D.groups(pairs_of(spark, list({(a, b): (a, b, *x) for a, b, *x in rows}.values())))
    thr = spark.createDataFrame([("us", 0.6)], "grp string, t double")
    key = lambda d: {(x.s1_id, x.s23_id) for x in d.where("selected").collect()}
    plain = key(D.by_threshold(df, thr))
    assert plain == key(D.rank_ladder(D.with_threshold(df, thr), (0.0, 0.0, 0.0), 0))
    owned = key(D.decide(df, thr))
    assert owned <= plain and len({b for _, b in owned}) == len(owned) == len({b for _, b in plain})
    swept = {x.t: x.macro_f for x in E.sweep(df, df.select("s1_id").distinct(), df.where("label = 1"), [0.3, 0.6, 0.95]).collect()}
    direct = E.macro_f(E.entity_counts(D.by_threshold(df, thr), df.select("s1_id").distinct(), df.where("label = 1"))).first()
    assert swept[0.6] == pytest.approx(direct.macro_f, abs=1e-6)


def test_f_half_example(spark):
    counts = spark.createDataFrame([(2.0, 3.0, 2.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)], "tp double, n_pred double, n_true double")
    got = [round(r[0], 3) for r in counts.select(E.f_half(F.col("tp"), F.col("n_pred"), F.col("n_true"))).collect()]
    assert got == [0.714, 1.0, 0.0]


def test_validator_and_files(spark, tmp_path):
    e = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    lines = spark.createDataFrame([("S1-1\tS2-1,S2-1",), ("S1-1\tS1-9",), ("S1-2 S2-4",), ("S1-8\tQ-1",)], "line string")
    got = {r.rule: r.n for r in Z.violations(lines, e).collect()}
    assert got == {"no_tab": 1, "duplicate_s1": 1, "duplicate_ids": 1, "s1_in_list": 1, "bad_prefix": 1, "missing_s1": 2, "unexpected_s1": 1}
    lists = spark.createDataFrame([("S1-2", ["S2-1", "S3-1"]), ("S1-1", [])], "s1_id string, matched array<string>")
    io.write_lists(lists, f"{tmp_path}/out")
    assert [r.line for r in io.read_lines(spark, f"{tmp_path}/out").orderBy("line").collect()] == ["S1-1\t", "S1-2\tS2-1,S3-1"]
    with pytest.raises(Exception, match="exist"):
        io.write_lists(lists, f"{tmp_path}/out")
    assert {r.id for r in io.read_ids(spark, f"{tmp_path}/out").collect()} == {"S1-1", "S1-2"}
    (tmp_path / "Train").mkdir()
    assert io.subdirectory(spark, str(tmp_path), "train").endswith("/Train")


def test_tsv_keeps_text(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tus\nS1-2\tnull\tx, y\t\n")
    rows = sorted(tuple(r) for r in io.read_tsv(spark, f"{tmp_path}/a.tsv").collect())
    assert rows == [("S1-1", "NA", "", "us"), ("S1-2", "null", "x, y", "")]


def test_merge_checks(spark):
    a, b = (spark.createDataFrame(x, "s1_id string, v string") for x in ([("1", "p")], [("2", "q")]))
    order = spark.createDataFrame([("2", 0), ("1", 1)], "s1_id string, pos int")
    assert [r.s1_id for r in io.merge_parts(order, [a, b]).collect()] == ["2", "1"]
    for parts in ([a, a, b], [a], [a, b.select("s1_id")]):
        with pytest.raises(ValueError):
            io.merge_parts(order, parts)


def test_calibration_is_monotone_and_config_round_trips(spark):
    knots = [(0.1, 0.0), (0.5, 0.5), (0.9, 1.0)]
    df = spark.range(101).select((F.col("id") / 100.0).alias("prob"))
    v = [r[0] for r in df.select(L.interpolate(F.col("prob"), knots).alias("y")).collect()]
    assert v == sorted(v) and v[0] == 0.0 and v[-1] == 1.0 and v[30] == pytest.approx(0.25)
    c = EngineConfig(candidate_cap=7)
    assert EngineConfig.from_json(c.to_json()) == c and c.cap_for("india") == 200 and c.cap_for("us") == 7


@pytest.mark.parametrize("cells", [0, 40, 10**9])
def test_search_equals_brute_force(cells, monkeypatch):
    """Scored pair by pair, mixed, or as dense products: copies, ties and empty vectors, in several blocks."""
    import pyarrow as pa

    from kinforge.operators import similarity as S

    monkeypatch.setattr(S, "DENSE", cells)
    r = random.Random(4)
    text = lambda: r.choices("abcdefghij", k=r.randint(1, 4))
    idf = pa.table({"token": list("abcdefghi"), "idf": [1.0 + i / 4 for i in range(9)]})
    vectors = lambda rows: S.Vectors(pa.table({"part": ["x"] * len(rows), "terms": pa.array(rows, pa.list_(pa.string()))}), idf)
    ask, found = [text() for _ in range(40)], [text() for _ in range(90)]
    ids = [sorted(f"{r.randrange(10**9):09}" for _ in range(r.randint(1, 4))) for _ in found]
    q, best = vectors(ask), S.Best(40, 4, 0.3)
    for lo in range(0, 90, 30):
        rows = pa.table({"part": ["x"] * 30, "ids": ids[lo : lo + 30], "terms": found[lo : lo + 30]})
        S.search(q, S.Index(S.Vectors(rows, idf).table(rows), q.words), best)
    x = vectors(found)
    row = lambda v, i: {int(c): w for a, c, w in zip(v.row, v.code, v.w, strict=True) if a == i}
    for i in range(40):
        a = row(q, i)
        all_ = [(-round(sum(w * b.get(c, 0.0) for c, w in a.items()), 6), n) for j in range(90) for b in [row(x, j)] for n in ids[j]]
        got = best.rows.filter(pa.compute.equal(best.rows.column("q"), i))
        assert sorted(zip([-s for s in got.column("score").to_pylist()], got.column("id").to_pylist(), strict=True)) == sorted(p for p in all_ if p[0] <= -0.3)[:4]


def test_equal_vectors_are_searched_for_once(spark, monkeypatch):
    """Vectors went to every block of the other side, one for each record; repeated ids are one document."""
    from kinforge.operators import similarity as S

    made = {}
    monkeypatch.setattr(S, "stage", lambda df, name: made.setdefault(name, df.localCheckpoint()))
    rows = [(f"a{i:04}", "s1", "us", "c", ["x", "y", "z"]) for i in range(300)] + [(f"b{i:04}", "s23", "us", "c", ["z", "x", "y"]) for i in range(300)]
    rows += [("b9999", "s23", "us", "c", ["x"]), ("b9999", "s23", "us", "c", ["y", "z", ""]), ("b9998", "s23", None, "c", ["x"])]
    docs = spark.createDataFrame(rows, "id string, side string, country string, channel string, terms array<string>")
    got = S.best_pairs(docs, 3, 0.1, EngineConfig(df_floor=1000)).collect()
    assert made["queries"].count() == made["searched"].count() == 1 and made["best"].count() == 3
    assert {(r.s1_id, r.s23_id, r["rank"]) for r in got} == {(f"a{i:04}", f"b{j:04}", j + 1) for i in range(300) for j in range(3)}


def test_blocks_hold_their_words_once():
    """Every reading of a searched block looked up each row's tokens as strings; now its words alone, in any order of rows."""
    import pyarrow as pa

    from kinforge.operators import similarity as S

    idf = pa.table({"token": ["d", "c", "b", "a"], "idf": [1.0, 1.5, 2.0, 2.5]})
    row = lambda ids, terms: pa.table({"part": ["x"] * len(ids), "ids": pa.array(ids, pa.list_(pa.string())), "terms": pa.array(terms, pa.list_(pa.string()))})
    found = row([["9"], ["3", "4"], ["1"]], [["a", "b", "a"], ["b", "c"], ["unknown"]])
    t = S.Vectors(found, idf).table(found)
    assert t.column("ids").to_pylist() == [["1"], ["3", "4"], ["9"]] and t.schema.field("codes").type.value_type == pa.int32()
    assert sorted(sum(t.column("words").to_pylist(), [])) == ["a", "b", "c", "d"]
    ask = row([["q"]] * 3, [["b"], ["a", "z"], ["z"]])
    q = S.Vectors(ask, pa.table({"token": ["z", "b", "a"], "idf": [1.0, 2.0, 2.5]}))
    out = []
    for rows in (t, t.take([2, 0, 1])):
        best = S.Best(3, 2, 0.1)
        S.search(q, S.Index(rows, q.words), best)
        out.append(best.rows.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")]).to_pydict())
    assert out[0] == out[1] and list(zip(out[0]["q"], out[0]["id"], strict=True)) == [(0, "3"), (0, "4"), (1, "9")]


def test_terms_are_made_distinct_once(spark, monkeypatch):
    """A filter that the planner made of explode() found every record's distinct terms a second time, and IDs were shuffled whole."""
    from kinforge.operators import similarity as S

    plans = {}
    real = S.stage

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(S, "stage", staged)
    rows = [("a1", "s1", "us", "c", ["x", "y", "y"]), ("b1", "s23", "us", "c", ["y", "x", "x", ""]), ("b2", "s23", "us", "c", ["", ""]), ("b3", "s23", "us", "c", None)]
    docs = spark.createDataFrame(rows, "id string, side string, country string, channel string, terms array<string>").localCheckpoint()
    got = S.best_pairs(docs, 3, 0.1, EngineConfig(df_floor=1000)).collect()
    assert [(r.s1_id, r.s23_id) for r in got] == [("a1", "b1")] and plans["df"].count("array_distinct") == 1 and "n" in plans


def test_blocks_fuse_as_rows_do(spark, monkeypatch):
    """Candidates were expanded to rows of every entity and shuffled; now they only come up in a block's task."""
    from kinforge.operators import fusion as B
    from kinforge.operators import retrieval as R
    from kinforge.operators import similarity as S

    monkeypatch.setattr(B, "PASS", 20)
    r, c, channels = random.Random(6), EngineConfig(df_floor=1000), ("a", "b")
    rows = [(f"{s}{i:03}", side, "us" if i % 3 else "france", ch, r.choices("uvwxyz", k=r.randint(1, 3))) for s, side, n in (("p", "s1", 30), ("q", "s23", 50)) for i in range(n) for ch in channels]
    docs = spark.createDataFrame(rows, "id string, side string, country string, channel string, terms array<string>").localCheckpoint()
    forward = S.best_pairs(docs, 9, 0.1, c).localCheckpoint()
    reverse = S.best_pairs(docs.where("channel = 'b'"), 2, 0.1, c, of="s23").localCheckpoint()
    lists, members, blocks = S.best_classes(docs, 9, 0.1, c, block=200)
    assert blocks > 1
    columns = {"n_channels": "long", "min_rank": "int", "sum_score": "double", "rrf": "double", "fused_rank": "int"}
    schema = "s1_id string, s23_id string, " + ", ".join(" ".join(x) for x in columns.items())
    then = lambda f: f.ids() | {x: f.fused_rank() if x == "fused_rank" else getattr(f, x) for x in columns}
    got = B.by_blocks(lists, members, blocks, channels, then, schema, c, reverse)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "others" in plan and "Window" not in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.fuse(forward, reverse, c).select("s1_id", "s23_id", *columns).collect()))


def test_ladder_grid_moves_pairs_once(spark):
    """Pairs were shuffled once for each of the grid's points where they were chosen."""
    from kinforge.operators import selection as C

    rows = [(f"S1-{i % 50}", f"S2-{i % 90}", "us", False, i % 2, i % 100 / 100, 1.9, 0.3) for i in range(450)]
    pairs = spark.createDataFrame(rows, "s1_id string, s23_id string, country string, addr_empty boolean, label int, prob double, weight double, t double")
    plan = C.ladder_grid(pairs, pairs.select("s1_id", "country").distinct())
    assert plan.count() == 167 and "NestedLoopJoin BuildRight, Inner" not in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_inputs(spark):
    none = D.groups(pairs_of(spark, []))
    thr = spark.createDataFrame([("us", 0.6)], "grp string, t double")
    assert D.decide(none, thr).count() == 0 and D.expected_f(none).count() == 0
    lists = D.match_sets(D.by_threshold(none, thr), spark.createDataFrame([("S1-1",)], "s1_id string")).collect()
    assert [tuple(r) for r in lists] == [("S1-1", [])]


def test_entry_without_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['kinforge.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'macro_f05' in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests", 1)[0])
