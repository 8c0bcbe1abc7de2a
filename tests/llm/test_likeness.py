"""Canonical text, near duplicates, similar vectors and name variants."""

import random
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import canonical_text, name_variants, near_duplicates, similar_vectors
from newsloom.runtime import pairs_within


@pytest.fixture(scope="module")
def canonical(spark):
    return canonical_text.Canonicalizer(canonical_text.look_alikes(spark))


SAME = [
    ("ＡＩ１２％", "AI12%"), ("Zoe\u0308", "Zoë"), ("沐\u200b川\ufeff宿\xad晖", "沐川宿晖"), ("a\u00a0b\u2003c\u3000d", "a b c d"), ("Реggу Нowеxsаpaѕ", "Peggy Howexsapas"), ("⼯业⾦融", "工业金融"),
    ("JQCХ 骏骐", "JQCX 骏骐"), ("ﬁn", "fin"), ("Ren\u200de\u0301 Bаtriс", "René Batric"), ("TＱΗJ霆骐", "TQHJ霆骐"), ("е\u0308x", "ëx"), ("a\r\nb", "a\nb"), ("各⼄", "各乙"),
]
DIFFERENT = [("Abc", "abc"), ("a  b", "a b"), ("x²", "x2"), ("①", "1"), ("陽", "阳"), ("привет мир", "privet mir"), ("I", "l"), ("0", "O"), ("rn", "m")]


@pytest.mark.parametrize(("one", "other"), SAME)
def test_same_form(canonical, one, other):
    assert canonical(one) == canonical(other) == canonical(canonical(one))


@pytest.mark.parametrize(("one", "other"), DIFFERENT)
def test_other_form(canonical, one, other):
    assert canonical(one) != canonical(other)


def test_joined_pictographs_stay(canonical):
    family = "👨\u200d👩\u200d👧"
    assert canonical(family) == family and canonical("a\u200db") == "ab" and canonical(None) is None and canonical("") == ""


def test_same_looking_pairs(spark):
    rows = [("chunk", "b", "ＡＢ"), ("chunk", "a", "AB"), ("chunk", "a", "AB"), ("chunk", "c", "AB"), ("entity", "d", "AB"), ("chunk", "n", None), ("chunk", "e", ""), ("chunk", "z", "\u200b"), ("chunk", "y", "AB\u200b" * 5000), ("chunk", "x", "AB" * 5000), (None, "q", "AB"), ("chunk", None, "AB")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec_kind string, rec_id string, text string, form int")
    got = {(r.rec_kind, r.id_a, r.id_b) for r in canonical_text.same_looking(df).collect()}
    assert got == {("chunk", "a", "b"), ("chunk", "b", "c"), ("chunk", "x", "y")}
    assert canonical_text.same_looking(df.limit(0)).count() == 0
    forms = {r.rec_id: r.canonical for r in canonical_text.canonical_forms(df.where("rec_id is not null"), ["rec_id"], "text").collect()}
    assert forms["b"] == "AB" and forms["n"] is None


def test_copies_of_a_hot_spelling_are_all_paired(spark):
    rows = [("chunk", f"a{i:04d}", "AB") for i in range(700)] + [("chunk", f"b{i}", "ＡB") for i in range(3)]
    df = spark.createDataFrame(rows, "rec_kind string, rec_id string, text string")
    got = {(r.id_a, r.id_b) for r in canonical_text.same_looking(df).collect()}
    assert got == {(f"a{i:04d}", f"b{j}") for i in range(700) for j in range(3)}
    assert {(r.class_id, r.spellings) for r in canonical_text.same_looking_classes(df).collect()} == {("a0000", 2)}


def test_every_composed_character_has_the_form_of_its_parts(canonical):
    for code in range(0x80, 0x30000):
        char = chr(code)
        apart = unicodedata.normalize("NFD", char)
        if not 0xD800 <= code < 0xE000 and char != apart and unicodedata.normalize("NFC", apart) == char:
            assert canonical(char) == canonical(apart) and canonical(f"x{char}y") == canonical(f"x{apart}y"), hex(code)


def _sets(text, k):
    return {text[i : i + k] for i in range(len(text) - k + 1)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(4, 60))]
        texts.append("".join(base))
        for _ in range(4):
            edited = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 6)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(edited)
            texts.append("".join(edited))
    rows = [("chunk", f"c{i:04d}", t) for i, t in enumerate(texts)] + [("chunk", "c0000", texts[0]), ("chunk", "copy", texts[0]), ("chunk", "null", None), ("chunk", "tiny", "甲"), ("chunk", None, texts[0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "rec_kind string, rec_id string, text string, band int").repartition(3)
    kept = {i: _sets(t, 5) for k, i, t in rows if i and t and len(t) >= 5}
    want = {(min(a, b), max(a, b)) for a, b in combinations(kept, 2) if len(kept[a] & kept[b]) >= 0.6 * len(kept[a] | kept[b])}
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, [near_duplicates.CHUNK]).collect()}
    assert not got - want and len(want - got) <= 0.02 * len(want) and len(want) > 100
    assert near_duplicates.near_duplicate_pairs(df.limit(0), [near_duplicates.CHUNK]).count() == 0


def test_copies_of_a_text_are_one_class_and_all_pairs(spark):
    rows = [("chunk", f"{i:04d}", "许多人转载了同一段文字内容") for i in range(600)] + [("chunk", "x", "许多人转载了同一段文字内容啊"), ("chunk", "y", "完全不同的另外一篇文章")]
    df = spark.createDataFrame(rows, "rec_kind string, rec_id string, text string")
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs(df, [near_duplicates.CHUNK]).collect()}
    names = [f"{i:04d}" for i in range(600)] + ["x"]
    assert got == set(combinations(names, 2))
    classes = {r.rec_id: (r.class_id, r.links) for r in near_duplicates.near_duplicate_classes(df, [near_duplicates.CHUNK]).collect()}
    assert classes["0599"] == ("0000", 1) and classes["x"] == ("x", 1) and classes["y"] == ("y", 0) and len(classes) == 602


def test_a_hot_band_is_divided(spark):
    """20,000 rows of one key: every pair meets once, and no task has more than a few blocks' pairs."""
    rows = spark.range(20_000).select(F.lit("k").alias("band"), F.col("id").alias("member"))
    met = pairs_within(rows, ["band"], ["member"], (F.col("a_member") + F.col("b_member")) % 5000 == 0)
    assert met.select(F.least("a_member", "b_member"), F.greatest("a_member", "b_member")).distinct().count() == met.count() == sum((min(s, 19_999) - max(0, s - 19_999) + 1) // 2 for s in range(5000, 39_999, 5000)) + 0
    keys = met.sparkSession.range(1).select(F.lit((20_000 / 512 + 1) ** 2 / 2).alias("n")).first().n
    assert keys > 700  # so many join keys of 512 * 512 pairs share the work


def test_sketch_estimates_similarity():
    rng = random.Random(1)
    for share in (0.3, 0.6, 0.9):
        both = [rng.random() for _ in range(int(400 * share))]
        sets = [both + [rng.random() for _ in range(400 - len(both))] for _ in range(2)]
        hashes = [near_duplicates.mix(np.array([hash(x) & 0xFFFFFFFF for x in s], dtype=np.uint64)) for s in sets]
        a, b = (near_duplicates.sketches(h, np.zeros(len(h), np.int64), 1, 512)[0] for h in hashes)
        assert abs((a == b).mean() - share / (2 - share)) < 0.09


def test_similar_vectors_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    sizes = rng.zipf(1.3, 30).clip(1, 400)
    x = np.concatenate([c + 0.4 * rng.normal(size=(s, 16)) for c, s in zip(centres, sizes)] + [rng.normal(size=(600, 16))]).astype(np.float32)
    x[5:15] = x[4]
    ids = [f"v{i:05d}" for i in range(len(x))]
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x)] + [("v00000", x[0].tolist(), 0), ("null", None, 0), ("zero", [0.0] * 16, 0), (None, x[1].tolist(), 0), ("short", [1.0], 0), ("nan", [float("nan")] * 16, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, code int").repartition(4)
    got = {}
    for r in similar_vectors.similar_vectors(df, 5, 0.5).collect():
        got.setdefault(r.chunk_id, {})[r["rank"]] = r.neighbour
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 12)
    hit = total = 0
    for i in range(len(x)):
        order = [j for j in sorted(range(len(x)), key=lambda j: (-scores[i, j], ids[j])) if j != i][:5]
        want = {ids[j] for j in order if scores[i, j] >= 0.5}
        total += len(want)
        hit += len(want & set(got.get(ids[i], {}).values()))
    assert hit >= 0.9 * total and total > 500
    assert [got["v00004"][k] for k in range(1, 6)] == [f"v{i:05d}" for i in range(5, 10)] and [got["v00014"][k] for k in range(1, 6)] == [f"v{i:05d}" for i in range(4, 9)]
    assert not {"null", "zero", "short", "nan"} & set(got)
    assert similar_vectors.similar_vectors(df.limit(0)).count() == 0


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(200, 24))
    x = similar_vectors._unit((centres[rng.integers(200, size=24_000)] + 0.6 * rng.normal(size=(24_000, 24))).astype(np.float32))
    centroids, pivots = similar_vectors.balanced_cells(x, 8)
    assert len(centroids) > 2 * similar_vectors.FEW  # so many that the graph is used
    graph = similar_vectors.CentroidGraph.build(centroids, np.concatenate([pivots, centroids[:: similar_vectors.PIVOT]]))
    ids, scores = graph.search(x[:500], 5)
    best = np.argmax(x[:500] @ centroids.T, axis=1)
    assert (ids[:, 0] == best).mean() > 0.95 and (np.diff(scores, axis=1) <= 1e-6).all()


def _recall(spark, x, k=5):
    df = spark.createDataFrame([(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<float>").repartition(4)
    got = {}
    for r in similar_vectors.similar_vectors(df, k).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for i in range(0, len(x), 7):
        scores = unit @ unit[i]
        scores[i] = -2
        hit += len({f"v{j:05d}" for j in np.argsort(-scores)[:k]} & got[f"v{i:05d}"])
    return hit / (k * len(range(0, len(x), 7)))


def test_recall_without_threshold_over_many_regions_shards_and_lists(spark, monkeypatch):
    """12,000 vectors in more than 1,000 lists, several shards and regions."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.zipf(1.5, 12_000).clip(1, 60) - 1] + 0.3 * rng.normal(size=(12_000, 32)) @ np.diag(1 / np.arange(1, 33) ** 0.5)).astype(np.float32)
    made = []
    monkeypatch.setattr(similar_vectors, "SHARD", 1500)
    monkeypatch.setattr(similar_vectors, "LIST", 20)  # 12,000 vectors, each in one list at least and in two shards or more
    fit = similar_vectors.Regions.fit.__func__
    monkeypatch.setattr(similar_vectors.Regions, "fit", classmethod(lambda cls, *a: made.append(fit(cls, *a)) or made[-1]))
    assert _recall(spark, x) >= 0.95
    assert len(made[0].readers) >= 2


def test_long_shards_are_divided_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    monkeypatch.setattr(similar_vectors, "LONGEST", 200)
    assert _recall(spark, x) >= 0.99


LEXICON = "term string, kind string, entity_type string, canonical string, ord int"


def test_name_variants(spark):
    cores = ["沐川宿晖", "骐祺川金", "义泰朗溪", "钧通骏霄", "明礼恒通", "荒航沐锐", "腾锦溪溪", "天玄鹏康", "朔列鸿曜", "恒义鼎泰", "远河和平", "宿松朔列"]
    names = [f"{p}{c}{t}股份有限公司" for c in cores for p in ("珩山", "澜州") for t in ("智能装备", "环境治理") if (p == "珩山") == (t == "智能装备")]
    names = [n for i, n in enumerate(names) if i % 2 == (cores.index(n[2:6]) % 2)]
    groups = [
        ["珩山沐川宿晖智能装备股份有限公司", "沐川宿晖股份", "沐\u200b川宿晖智能装备", "智能装备沐川宿晖股份有限公司", "珩山沐川宿辉智能装备股份有限公司", "沐川宿晖智能装备（珩山）股份有限公司", "Muchuan Suhui Group Co., Ltd."],
        ["珩山沐川宿晖智能装备股份有限公司第一营业部"],
        ["珩山沐川宿晖智能装备股份有限公司第二营业部"],
        ["司昱凯", "司昱凯先生", "董事长司昱凯", "司·昱凯", "司昱凱", "Yukai 司"],
        ["缪荒飞"],
        ["Theodore Linsolnepol", "T. Linsolnepol", "LINSOLNEPOL, T.", "Linsolnepol Theodore", "Ted Linsolnepol", "Theodore Linsolnepool", "theodore linsolnepol", "Dr. Theodore Linsolnepol", "Theodore Linsolnepol, CFA"],
        ["Edward Linsolnepol"],
        ["玄洲证券监督管理委员会", "玄证监"],
    ]
    groups += [[n] for n in names if n != groups[0][0]]
    # short forms are learned: Ted and Theodore share three more surnames of many
    groups += [[f"Theodore {s}", f"Ted {s}"] for s in ("Vantorquil", "Moswelpan", "Kidgavolo")]
    groups += [[f"{g} {s}"] for g, s in zip(["Robert", "Alice", "Edward"] * 6, ["Bruvenzo", "Calmidor", "Dastfelm", "Erquonis", "Fjordwin", "Gapselko", "Hulmbrat", "Ixtavori", "Jemprudo", "Kwarzenu", "Lopfigam", "Mudqesti", "Nyrbovex", "Oxculpha", "Pimdrego", "Quastivu", "Rhezomil", "Sturbacq"])]
    flat = [(name, g) for g, group in enumerate(groups) for name in group]
    rows = [(i, name, "公司", 0) for i, (name, _) in enumerate(flat)]
    extra = [(900, flat[0][0], "Entity", 0), (901, None, "公司", 0), (902, " ", "公司", 0), (903, "关于某事项的第3号公告", "文档", 0), (0, flat[0][0], "公司", 0), (904, "长" * 5000, "公司", 0)]
    entities = spark.createDataFrame(rows + extra, "entity_id bigint, name string, entity_type string, body int")
    relations = spark.createDataFrame([(name, flat[0][0]) for name, _ in flat] + [(None, None)], "source string, target string")
    lexicon = spark.createDataFrame([("玄洲证券监督管理委员会", "institution", "机构", "玄洲证券监督管理委员会", 0), ("玄证监", "alias", "机构", "玄洲证券监督管理委员会", 1), (None, "alias", None, None, None)], LEXICON)
    got = {(r.entity_a, r.entity_b) for r in name_variants.found_variants(entities, relations, lexicon).collect()}
    want = {(i, j) for i, j in combinations(range(len(flat)), 2) if flat[i][1] == flat[j][1]} | {(i, 900) for i, (_, g) in enumerate(flat) if g == 0}
    assert not got - want, [(flat[a][0], flat[b][0]) for a, b in got - want if b < 900]
    assert len(want - got) <= 0.1 * len(want), [(flat[a][0], flat[b][0]) for a, b in want - got if b < 900]
    assert name_variants.found_variants(entities.limit(0), relations.limit(0), lexicon.limit(0)).count() == 0


def test_partners_are_learned():
    counts = {"margaret": 18, "peggy": 2, "robert": 17, "john": 300, "mary": 280}
    found = name_variants.learn_partners([("margaret", "peggy", 2), ("margaret", "robert", 1), ("john", "mary", 90)], counts, 1000)
    assert found == {"margaret": {"peggy"}, "peggy": {"margaret"}}


def test_partners_of_crowded_surnames(spark):
    """Short forms whose surnames all have more than MOST_GIVEN given names; other names of those surnames aren't linked."""
    crowded = [f"crowd{i}" for i in range(40)]
    rows = [(s, f"own{i}x{j}") for i, s in enumerate(crowded) for j in range(60)] + [(s, g) for s in crowded[:20] for g in ("theodore", "ted")]
    rows += [(crowded[i], f"rare{j}") for j in range(20) for i in (j % 12, (j * 5 + 1) % 12)] + [(f"lone{i}", f"name{i % 40}") for i in range(2000)]
    read = spark.createDataFrame([("latin", s, g) for s, g in rows], "kind string, core string, place string")
    assert name_variants._partners(read) == {"theodore": {"ted"}, "ted": {"theodore"}}
    assert name_variants._partners(read.limit(0)) == {}


def test_all_readings_of_a_romanised_name():
    words = [["yu", "e", "chuan", "e", "jiang"], ["zui", "e", "kuo", "xian", "geng"], ["xi", "an", "xi", "an", "xi", "an"], ["mu", "chuan"]]
    said = {x for w in words for x in w} | {"xian", "yue", "ec", "chu", "an", "a", "n", "ku", "o", "kuox", "gen", "g", "i", "ji", "ang", "jian", "ch", "u"}
    sounds = {chr(0x4E00 + i): x for i, x in enumerate(sorted(said))}
    reader = name_variants.Reader(name_variants.Letters(sounds, {}, {}), {}, set())

    def brute(rest, room):
        if not rest:
            return {()}
        if not room:
            return set()
        return {(sound, *more) for k in range(1, min(8, len(rest)) + 1) for sound in {rest[:k], rest[: k - 1] if rest[k - 1] in "heu" else rest[:k]} if sound in said for more in brute(rest[k:], room - 1)}

    for word in words:
        got = {syllables for syllables, _ in reader.romanised("".join(word))}
        assert tuple(word) in got and got == {x for x in brute("".join(word), 6) if len(x) >= 2}
    assert reader.romanised("xian" * 5000) == [] == reader.romanised("")


@pytest.mark.parametrize(("bound", "what"), [("MOST_CONFUSED", "confused characters"), ("MOST_SPELLED", "spellings of characters")])
def test_learned_tables_are_never_cut(spark, monkeypatch, bound, what):
    cores = ["沐川宿晖", "沐川宿辉", "荒航沐晖", "荒航沐辉", "义泰朗溪", "钧通骏霄", "明礼恒通", "朔列鸿曜", "恒义鼎泰", "远河和平", "腾锦溪溪", "天玄鹏康"]
    names = [f"珩山{c}智能装备股份有限公司" for c in cores] + ["Mingli Hengtong Co., Ltd."]
    entities = spark.createDataFrame(list(enumerate(names)), "entity_id bigint, name string")
    relations = spark.createDataFrame([(n, n) for n in names], "source string, target string")
    monkeypatch.setattr(name_variants, bound, 0, raising=False)
    with pytest.raises(ValueError, match=what):
        name_variants.name_bodies(entities, relations, spark.createDataFrame([], LEXICON))


def test_ends_of_cores_are_no_trades_however_many_names_there_are(spark):
    """Every last character of a core with 股份 has as many neighbours as a trade."""
    rng = np.random.default_rng(3)
    cores = sorted({"".join(rng.choice(list("沐川宿骐金义泰朗溪钧通骏霄明礼恒荒航锐腾锦天玄鹏"), 4)) for _ in range(450)})
    companies = [(f"{('珩山', '澜州')[i % 2]}{c}{('智能装备', '环境治理')[i // 2 % 2]}有限公司", f"{c}股份") for i, c in enumerate(cores)]
    names = [n for pair in companies for n in pair]
    entities = spark.createDataFrame(list(enumerate(names)), "entity_id bigint, name string")
    relations = spark.createDataFrame([(a, a) for a, _ in companies], "source string, target string")
    body = {r.entity_id: r.body for r in name_variants.name_bodies(entities, relations, spark.createDataFrame([], LEXICON)).collect()}
    apart = [companies[i] for i in range(len(companies)) if body[2 * i] != body[2 * i + 1]]
    assert not apart, (len(apart), apart[:3])


def test_coincidences_are_weighed_against_chance():
    assert name_variants.beyond_chance(2, 0) and name_variants.beyond_chance(2, 2e-5) and name_variants.beyond_chance(400, 20.0)
    assert not name_variants.beyond_chance(2, 0.15) and not name_variants.beyond_chance(3, 0.15) and not name_variants.beyond_chance(25, 20.0)


def test_components(spark):
    nodes = spark.range(1, 60).toDF("node")
    edges = spark.range(1, 40).selectExpr("id as node", "id + 1 as parent")
    out = {r.node: r.root for r in name_variants.components(nodes, edges).collect()}
    assert all(out[n] == 1 for n in range(1, 41)) and all(out[n] == n for n in range(41, 60))
