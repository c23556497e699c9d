"""The corpus operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nocturne.llm import language, line_dedup, mixing, packing, quality, queries, repetition, simhash, suffix, topk, toxicity
from nocturne.llm.common import fold, ranked, sampled_ids, table, texts_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")
# names that operators use inside, on columns of the input
CLASHING = {"_row": 7, "copies": 5, "score": "x", "rank": 1, "doc": 2, "line": 3, "row": 4, "fp": 5, "length": 6, "size": 8, "words": 9, "key": 10, "lang_pred": 11}


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, None, None),
        (None, "some text without an id", "en", "a", 3),
        (None, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t\n ", "en", "b", 5),
        (4, "the same line again\nthe same line again\n", "en", "a", 5),
        (4, "the same line again\nthe same line again\n", "en", "a", 5),
        (5, long, "de", "b", 5),
        (6, long + " more", "de", "b", 5),
        (7, "12 34 !!", "fr", None, 1),
        (8, "Straße É中文 \U0001f600 end", "de", None, 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASHING.items()})


OPERATORS = {
    "mixing": mixing.mix_sources,
    "mixed": mixing.mixed_documents,
    "lines": line_dedup.line_report,
    "without lines": line_dedup.without_repeated_lines,
    "language": lambda d: language.identify(d, *language.learn_profiles(d)),
    "quality": lambda d: quality.score_quality(d, None),
    "toxicity": lambda d: toxicity.score_toxicity(d, {}, np.zeros(6)),
    "repetition": repetition.repetition_rules,
    "packing": lambda d: packing.pack(d, PATH),
    "simhash": simhash.near_duplicates,
    "without copies": simhash.without_near_duplicates,
    "suffix": suffix.remove_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    rows = odd(spark)
    got = OPERATORS[name](rows).collect()
    if name in ("mixing", "lines", "language", "quality", "toxicity", "repetition", "simhash", "suffix"):
        assert len(got) == rows.count()
    assert OPERATORS[name](rows.limit(0)).count() == 0


def test_stages_leave_other_columns_alone(spark):
    rows = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        assert {tuple(r[c] for c in CLASHING) for r in out.collect()} <= {tuple(CLASHING.values())}, name
        assert stage(spark, rows.limit(0), SF).count() == 0


def test_classifiers_fit_on_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], DOCS)
    assert quality.fit(none, labels) is None
    stems, weights = toxicity.fit(none, labels)
    rows = odd(spark)
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score_toxicity(rows, stems, weights).collect())
    nulls = spark.createDataFrame([(None, None, None), (2, 1, 1), (4, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    quality.fit(rows, nulls)
    toxicity.fit(rows, nulls)


def test_fitted_models_on_odd_rows(spark, docs):
    labels = table(spark, SF, "labels")
    rows = odd(spark)
    model = quality.fit(docs, labels)
    stems, weights = toxicity.fit(docs, labels)
    assert model is not None and any(stems.values())
    for told in (quality.score_quality(rows, model), toxicity.score_toxicity(rows, stems, weights)):
        got = told.collect()
        assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) <= 2  # null, empty and blank texts


def test_results_do_not_depend_on_partitions(spark, docs):
    some = docs.limit(120).cache()
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for f in (mixing.mix_sources, line_dedup.line_report, suffix.remove_repeats, simhash.near_duplicates):
        drop = lambda df: f(df).drop("row", "kept")  # noqa: B023, E731
        assert key(drop(some.repartition(1))) == key(drop(some.repartition(7)))


def test_ranks_are_a_count_from_zero(spark):
    df = spark.range(500).selectExpr("id % 3 AS g", "id % 5 AS a", "id % 7 AS b", "id")
    got = ranked(df, ["g"], ["a", "b"], ["id"], "r").collect()
    for g in range(3):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: (r["a"], r["b"], r["id"]))
        assert [r["r"] for r in rows] == list(range(len(rows)))


# --- 1, mixing ---


def test_targets_are_filled_level_by_level(spark):
    sizes = {"a": 100, "b": 10, "c": 50, "d": 1000, None: 5}
    df = spark.createDataFrame([(int(k is None), k or "", v) for k, v in sizes.items()], "no_source int, source string, source_size long")
    got = {r["source"] or None: r["target"] for r in mixing.source_targets(df).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    want, free, left = {}, set(weights), float(sum(sizes.values()))
    while True:
        share = {k: left * weights[k] / sum(weights[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
        free -= over
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_words_taken_come_near_the_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), "en", f"s{rng.choice([0, 0, 0, 0, 1, 2, 3])}", 0) for i in range(4000)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).join(spark.createDataFrame(rows, DOCS).select("doc_id", "source"), "doc_id")
    assert mixed.where("taken > 3 * size").count() == 0
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_offset_of_the_grid_comes_nearer(spark, sf):
    """The words taken for each offset, summed up plainly."""
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for source, own in rows.groupby(rows["source"].fillna("")):
        own = own.assign(tier=np.floor(np.sqrt(own["size"].astype(float))), bucket=(own["doc_id"] % 65521 * 40503 + 977) % 65521 % 64).sort_values(["tier", "bucket", "size", "doc_id"])
        rate = own["target"].iloc[0] / own["source_size"].iloc[0]
        start = int(hashlib.md5(f"17:{int(source == '')}:{source}".encode()).hexdigest()[:5], 16) / 1048576 / 256
        sums = rate * np.arange(len(own) + 1) + start
        misses = [abs(float((np.diff(np.floor(sums + j / 256)) * own["size"].to_numpy()).sum()) - own["target"].iloc[0]) for j in range(256)]
        assert abs(own["taken"].sum() - own["target"].iloc[0]) == pytest.approx(min(misses), abs=1e-6)
        if own["size"].max() < 0.02 * own["target"].iloc[0]:
            assert min(misses) <= 0.02 * own["target"].iloc[0]


# --- 2, lines ---


def plain_lines(rows):
    """Which lines have a similar one before them, by comparison of all pairs."""
    lines = [(d, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x))) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    gone = set()
    for i, (d, k, s) in enumerate(lines):
        if any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:i]):
            gone.add((d, k))
    return gone


@pytest.mark.parametrize("seed", range(2))
def test_lines_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [[f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 25))] for _ in range(12)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"t{rng.randrange(90)}"
        rng.shuffle(words)
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(5)))) for i in range(80)]
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == plain_lines(rows)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = plain_lines(rows)
    for i, t in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert kept.get(i, "") == (left if left.strip() or not any(g[0] == i for g in gone) else "")


@pytest.mark.parametrize("crowd", [20_000, 6])
def test_every_link_is_counted(spark, monkeypatch, crowd):
    """Groups of near copies: all pairs of distinct sets count once, also where a word's lines are dealt out over several cells."""
    monkeypatch.setattr(line_dedup, "COMPARED", 50)
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(3)
    base = [[f"t{rng.randrange(60)}" for _ in range(rng.randrange(4, 25))] for _ in range(4)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"t{rng.randrange(90)}"
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(5)))) for i in range(90)]
    sets = {i: [frozenset(x.split()) for x in t.split("\n") if x.split()] for i, t in rows}
    distinct = {s for own in sets.values() for s in own}
    links = {s: sum(s != o and 5 * len(s & o) >= 4 * len(s | o) for o in distinct) for s in distinct}
    assert max(links.values()) > 5
    got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: sum(links[s] for s in own) for i, own in sets.items()}
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == plain_lines(rows)


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(2, "a b c d e f\nonly here x y z"), (2, "g h i j k l\na b c d e f"), (1, "g h i j k l"), (2, "a b c d e f\nonly here x y z"), (None, "q r s t u v"), (None, "q r s t u v\nnew w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["n_lines"], tuple(r["removed"])) for r in line_dedup.line_report(df).collect())
    assert got == [(0, 1, ()), (0, 2, (0,)), (1, 1, ()), (2, 2, ()), (2, 2, (0, 1)), (2, 2, (0, 1))]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeated_lines(df).collect())
    assert kept == [(0, "new w"), (0, "q r s t u v"), (1, "g h i j k l"), (2, "a b c d e f\nonly here x y z")]


# --- 3, 4, 5, classifiers on the labels that they don't see ---


def test_languages_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    told = queries.op3_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert told.where("lang_pred = lang").count() / told.count() > 0.97
    assert told.where("score < 0 or score > 1").count() == 0


def test_no_letter_is_no_language(spark):
    df = spark.createDataFrame([(1, "12 %% 3"), (2, None), (3, "the cat and the dog")], "doc_id long, text string")
    learned = language.learn_profiles(spark.createDataFrame([("the bird and the fish", "en"), ("der hund und die maus", "de")], "text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(df, *learned).collect()} == {1: "und", 2: "und", 3: "en"}


def test_stage_rejects_what_no_profile_is_near(spark, docs):
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(1500))
    rows = [(-1, noise, None, "a", 0), (-2, "12 %% 34", "en", "a", 0), (-3, None, "en", "a", 0)]
    kept = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, DOCS)), SF)
    assert kept.where("doc_id < 0").count() == 0
    assert docs.join(kept, "doc_id", "left_anti").where(F.length(F.regexp_replace("text", r"[^a-z]", "")) > 20).count() == 0


def test_ngram_vectors_are_products_of_permuted_letters():
    gram = lambda a, b, c: (a << 42) | (b << 21) | c
    m = language.ngram_vectors(np.array([gram(3, 4, 5), gram(3, 4, 6), gram(7, 8, 5), gram(7, 8, 6), gram(0x10FFFF, 0, 0x4E2D)]))
    assert set(np.unique(m)) == {-1, 1}
    assert (m[0] * m[1] == m[2] * m[3]).all()
    # letters are as good as independent, whatever their code points
    v = language.letter_vectors(np.array([97, 98, 241, 246, 231, 0x3B1, 0x3B2, 0x4E00, 0x4E01, 0x1F600])).astype(int)
    assert np.abs((v @ v.T / language.DIMENSIONS)[~np.eye(10, dtype=bool)]).max() < 0.15


def test_scripts_beyond_latin_are_told_apart(spark):
    """Four languages in alphabets of their own, two of them in the same one, and accents that alone make the difference."""
    texts = {
        "el": "το σπίτι είναι μεγάλο και ο κήπος έχει πολλά δέντρα κοντά στη θάλασσα και τα παιδιά παίζουν κάθε μέρα",
        "ru": "дом большой и в саду много деревьев рядом с морем и дети играют там каждый день после школы",
        "uk": "будинок великий і в садку багато дерев біля моря і діти грають там щодня після школи та їдять ягоди",
        "zh": "房子很大花园里有很多树靠近大海孩子们每天放学后都在那里玩",
        "ar": "البيت كبير وفي الحديقة أشجار كثيرة قرب البحر والأطفال يلعبون هناك كل يوم بعد المدرسة",
        "x1": "bañe moñi tuñu keñe ruñi bañe toñu", "x2": "baöe moöi tuöu keöe ruöi baöe toöu", "x3": "baçe moçi tuçu keçe ruçi baçe toçu",
    }
    langs, prototypes = language.learn_profiles(spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, lang string"))
    asked = {"el": "τα παιδιά και το σπίτι κοντά στη θάλασσα", "ru": "дети играют в саду рядом", "uk": "діти грають щодня біля моря", "zh": "孩子们每天放学后玩", "ar": "الأطفال يلعبون كل يوم", "x1": "muñe reñi", "x2": "muöe reöi", "x3": "muçe reçi"}
    names, scores = language.classify(list(asked.values()), langs, prototypes)
    assert names.tolist() == list(asked) and scores.min() > 0.1


def test_quality_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    told = queries.op4_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (told["predicted"] == told["quality"]).mean() > 0.95
    assert ((told["score"] >= 0.3) == (told["predicted"] == 1)).all() and told["score"].between(0, 1).all()


def test_toxicity_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    told = queries.op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    toxic = told["toxic"] == 1
    assert told["predicted"][toxic].mean() > 0.9 and told["predicted"][~toxic].mean() < 0.02


def test_grammar_weighs_clauses():
    key = toxicity._Tokens(["fool"]).stems(0)[1].view(np.int64)[0]
    points = toxicity.clause_scores(["a fool.", "you fool.", "you are not a fool.", "he said you fool.", "nothing here.", "", None, "I will kill you.", "kill time."], {0: {int(key): 3.0}})[:, 0]
    plain, aimed, denied, told, none, empty, null, threat, idle = points
    assert aimed > plain > denied > 0 and aimed > told > 0
    assert none == empty == null == idle == 0 and threat > 0


def test_threats_keep_what_stands_before_them():
    texts = ["i will kill you.", "i will never kill you.", "nobody will hurt him.", "they said he will kill you.", "you, kill.", "you kill.", "you never kill.", "kill never you.", "kill\nyou", "said kill never hurt you"]
    plain, never, nobody, told, apart, after, denied, stronger, lines, both = toxicity.clause_scores(texts, {})[:, 0]
    assert plain == after == stronger == 2.0 and never == nobody == denied == pytest.approx(0.4)
    assert told == 1.0 and apart == lines == 0 and both == 1.0
    fool = {0: {int(toxicity._Tokens(["fool"]).stems(0)[1].view(np.int64)[0]): 3.0}}
    aimed, off = toxicity.clause_scores(["a fool you.", "not a fool you."], fool)[:, 0]
    assert off == aimed / 2


def test_contractions_capitals_and_what_waits():
    fool = {0: {int(toxicity._Tokens(["fool"]).stems(0)[1].view(np.int64)[0]): 9.0}}
    texts = ["you fool", "fool you", "I won't kill you", "I can’t hurt you", "he doesn't. kill you", "TÖTEN dich", "töten dich", "I WILL KILL YOU", "fool never fool you"]
    before, behind, wont, cant, apart, upper, lower, loud, two = toxicity.clause_scores(texts, fool)[:, 0]
    assert before == behind == 13.5
    assert wont == cant == pytest.approx(0.4)
    assert apart == upper == lower == loud == 2.0
    assert two == 9.0 + 4.5 + 4.5  # both count, the second denied; the first one waits for its target


def test_threats_are_learned(spark):
    """A verb that is harmless alone and toxic with a target is a threat, one that is toxic anywhere an insult."""
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice(["tree", "lake", "bread", "road", "cloud"]) for _ in range(8))
    rows = [(f"{filler()}. i will mangle you. {filler()}", 1) for _ in range(30)] + [(f"{filler()}. what a wuzzard. {filler()}", 1) for _ in range(30)]
    rows += [(f"{filler()}. they who mangle bread {filler()}".replace("they", "some"), 0) for _ in range(60)] + [(f"{filler()}. you see {filler()}", 0) for _ in range(100)]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "text string, toxic int"))
    key = lambda w: int(toxicity._Tokens([w]).stems(0)[1].view(np.int64)[0])
    assert key("mangle") in stems["threat", 0] and key("mangle") not in stems[0]
    assert key("wuzzard") in stems[0] and key("wuzzard") not in stems["threat", 0]
    assert toxicity.clause_scores(["we mangle", "mangle them", "wuzzard"], stems)[:, 2].tolist() == [0, 1, 1]


def test_composed_grammar_equals_its_parts():
    """The five transducers one by one, against the one table that they make."""
    t, table, rng = toxicity.transducers(), toxicity.grammar(), random.Random(0)
    for _ in range(300):
        state, own, total = 0, dict.fromkeys(t, 0), [0.0, 0.0]
        for _ in range(rng.randrange(25)):
            symbol = rng.randrange(toxicity.SYMBOLS)
            total[0] += table.points[state, symbol]
            state = table.next[state, symbol]
            flags = 0
            for name in ("negation", "reported"):
                flags |= t[name].flags[own[name], symbol]
                own[name] = t[name].next[own[name], symbol]
            for name in ("insult", "threat", "target"):
                total[1] += t[name].points[own[name], symbol + toxicity.SYMBOLS * flags]
                own[name] = t[name].next[own[name], symbol + toxicity.SYMBOLS * flags]
        assert total[0] == pytest.approx(total[1])


def test_language_gram_by_gram():
    """Bundles and cosines, one letter and one n-gram at a time."""
    base = {c: language.letter_vectors(np.array([c]))[0].astype(float) for c in [0, *range(97, 123)]}

    def bundle(text):
        words = [[ord(c) for c in w] for w in re.findall("[a-z]+", text.lower())]
        letters = [0] + [x for w in words for x in [*w, 0]]
        out = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if b:
                out += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
        return out

    known = {"en": "the cat and the dog are in the house", "xx": "zuk zuk bolo mak tu zuk"}
    langs = sorted(known)
    prototypes = np.array([bundle(known[k]) for k in langs])
    texts = ["a cat in a house", "bolo zuk", "Dog! and; mak", "123"]
    names, scores = language.classify(texts, langs, prototypes)
    for text, name, score in zip(texts, names, scores, strict=True):
        own = bundle(text)
        cosines = [own @ p / max(1e-12, np.linalg.norm(own) * np.linalg.norm(p)) for p in prototypes]
        assert (name, score) == (("und", 0) if not own.any() else (langs[int(np.argmax(cosines))], pytest.approx(max(0, *cosines), abs=1e-5)))


def test_learned_profiles_are_sums(spark):
    rows = [("the cat", "en"), ("zuk bolo", "xx"), ("a dog", "en"), (None, "en"), ("lost", None), ("the cat", "en")]
    langs, prototypes = language.learn_profiles(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    for lang, found in zip(langs, prototypes, strict=True):
        grams = np.concatenate([language.ngrams([t])[1] for t, k in rows if k == lang and t])
        assert (found == language.ngram_vectors(grams).astype(float).sum(0)).all()


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0.0] * 16
    t, n = text, len(words)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    size = [len(w) for w in words]
    letter = lambda c: "a" <= chr(ord(c) | 32) <= "z" or ord(c) >= 192
    symbol = lambda c: c in "#*$%&|<>{}[]=\\/@^~_+"
    share = lambda f: sum(map(f, t)) / len(t)
    return [
        math.log1p(n), sum(size) / n, float(np.std(size)), len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(a == b for a, b in zip(words, words[2:])) / n,
        share(letter), share(symbol), share(lambda c: "0" <= c <= "9"), share(lambda c: "A" <= c <= "Z"), share(lambda c: c in ".,;:!?"),
        sum(not any(map(letter, w)) for w in words) / n, sum(symbol(w[-1]) for w in words) / n, n / len(lines),
        (len(lines) - len(set(lines))) / len(lines), sum(words.count(w) > 1 for w in words) / n,
    ]


def test_features_one_by_one(docs):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é9.#A\n ") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", " \n"] + [r["text"] for r in docs.limit(20).collect()]
    assert np.allclose(quality.features(texts), [plain_features(t) for t in texts], atol=1e-6)


def test_risk_gradient_by_differences():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    seen = set()
    for _ in range(40):
        w, prior = rng.normal(0, 2, 5), rng.uniform(0.1, 0.9)
        gain, loss = quality.risk_parts(w, p, u, prior)
        seen.add(loss < 0)
        sign = lambda w: -quality.risk_parts(w, p, u, prior)[1] if loss < 0 else sum(quality.risk_parts(w, p, u, prior))  # noqa: B023, E731
        found = [(sign(w + 1e-6 * e) - sign(w - 1e-6 * e)) / 2e-6 for e in np.eye(5)]
        assert np.allclose(quality.risk_gradient(w, p, u, prior), found, atol=1e-5)
    assert seen == {True, False}


def test_samples_count_an_id_once(spark):
    """However many rows an id has, no more than the bound comes to the driver, and the same texts."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    many = docs.crossJoin(spark.range(5).select("id")).select("doc_id", F.when(F.col("id") == 0, F.col("text")).otherwise(F.concat("text", F.lit(" again"))).alias("text"))
    chosen = sampled_ids(many, 4, 30)
    ids = sorted(r[0] for r in chosen.collect())
    assert len(set(ids)) == len(ids) == 30 and ids == sorted(r[0] for r in sampled_ids(docs, 4, 30).collect())
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(4)), 1)).collect()}
    assert ids == sorted(sorted(hashes, key=hashes.get)[:30])
    rows = texts_of(many, chosen.withColumn("p", F.lit(1))).collect()
    assert len(rows) == 30 and {r["text"] for r in rows} == {r["text"] for r in texts_of(many.repartition(7), chosen.withColumn("p", F.lit(1))).collect()}
    assert sorted(r[0] for r in sampled_ids(docs, 4, 1000).collect()) == list(range(400))


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    u = np.concatenate([rng.normal(3, 1, 7000), rng.normal(-3, 1, 3000)])
    assert quality.class_prior(rng.normal(3, 1, 5000), u) == pytest.approx(0.7, abs=0.05)


# --- 7, packing ---


def test_ids_are_the_tokenizers_own():
    rng, t, own = random.Random(0), Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    letters = "abZéÉßüÇœİſǅΣσж中あ012½ '’_.,;!?|#*$<>()[]^`~-—…  \u0085\x1c\x1f\x0b\n\t́\U0001f600"
    for text in ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["<|endoftext|>", "it's we'LL", "ab<|startoftext|>c", ""]:
        assert np.frombuffer(own(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_whole(spark, docs):
    pieces = packing.pack(docs, PATH).toPandas().sort_values(["sequence_id", "offset"])
    assert (pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"] == pieces["offset"]).all()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096
    assert pieces["sequence_id"].nunique() <= 1.05 * math.ceil(pieces["length"].sum() / 4096) + 1
    t = Tokenizer.from_file(PATH)
    for r in docs.limit(40).collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
        own = pieces[pieces["doc_id"] == r["doc_id"]].sort_values("piece")
        assert list(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(3000):
        n = min(400, max(1, int(rng.lognormvariate(4, 1.2))))
        counts[n] = counts.get(n, 0) + 1
    steps = packing.plan(counts, 400, 12, 2)
    filled, seen = {}, {}
    for n, first, many, sequence, offset, times in steps.tolist():
        assert first == seen.get(n, 0)
        seen[n] = first + many
        for i in range(many):
            filled.setdefault(sequence + i // times, []).append((offset + i % times * n, n))
    assert seen == counts
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 400
    assert len(filled) <= 1.02 * sum(n * c for n, c in counts.items()) / 400 + 2


# --- 8, top-k ---


@pytest.mark.parametrize("n,dim,k", [(400, 8, 20), (15, 3, 20), (300, 1, 5)])
def test_top_k_matches_all_products(spark, n, dim, k):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dim), 1 if dim < 8 else 6)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0] * (dim - 1) + [None]), (n + 2, [float("nan")] * dim), (None, [1.0] * dim), (n + 3, [1.0] * (dim + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k, shard_rows=60, block_rows=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows if i is not None and x is not None and i < n}
    for q in range(0, n, 20):
        every = sorted(((int(ints[q] @ v), i) for i, v in ints.items() if i != q), key=lambda x: (-x[0], x[1]))[:k]
        assert got[q] == {j + 1: (i, s) for j, (s, i) in enumerate(every)}


@pytest.mark.parametrize("large", [7, 20])
def test_one_large_vector_leaves_the_others_their_hits(spark, large):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(300)]
    rows[large][1][3] = 3e6
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 10, shard_rows=60, block_rows=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ints = {i: [math.floor(64 * y) for y in x] for i, x in rows}
    for q in range(0, 300, 20):
        every = sorted(((sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q), key=lambda x: (-x[0], x[1]))[:10]
        assert got[q] == {j + 1: (i, s) for j, (s, i) in enumerate(every)}


def test_top_k_of_nothing_of_repeats_and_of_crowds(spark):
    schema = "vec_id long, embedding array<double>"
    asked = F.col("vec_id") % 20 == 0
    assert topk.top_k(spark.createDataFrame([], schema), asked).count() == 0
    assert topk.top_k(spark.createDataFrame([(None, [1.0]), (20, None)], schema), asked).count() == 0
    # a third of all rows are one vector, which no plane can cut; repeated ids count each as candidates and never answer themselves
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [float(i % 7), -float(i % 5)]) for i in range(150)] + [(1, [9.0, 9.0])] * 2 + [(20, [8.0, 8.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, schema), asked, 4, shard_rows=16, block_rows=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    ints = [(i, [math.floor(64 * y) for y in x]) for i, x in rows]
    for q in range(0, 150, 20):
        every = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for k, x in ints if k == q for i, y in ints if i != q))[:4]
        assert sorted(got[q]) == [(j + 1, -s, i) for j, (s, i) in enumerate(every)]


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(500, 6)), rng.normal(size=(20, 6))
    tree = topk.BallTree(v, 16)
    for node in range(len(tree.start)):
        own = v[tree.order[tree.start[node] : tree.end[node]]]
        assert (q @ own.T <= tree.bounds(q, [node])).all()


# --- 9, SimHash ---


def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_majorities(docs):
    for r in docs.limit(60).collect():
        assert simhash.fingerprint(r["text"], 3) == plain_fingerprint(r["text"], 3)
    for text in (None, "", " \n", "One", "One TWO", "É é İ"):
        assert simhash.fingerprint(text, 3) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("seed,budget", [(0, 2), (1, 3), (2, 0)])
def test_trie_finds_every_pair(seed, budget):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = np.unique(np.array([x ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for x in seeds * 20], np.uint64))
    got = {tuple(sorted((int(i), int(j)))) for a, b in simhash.trie_pairs(values, None, budget) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= budget}
    assert got == want
    left, right = values[::2], values[1::2]
    got = {(int(left[i]), int(right[j])) for a, b in simhash.trie_pairs(left, right, budget) for i, j in zip(a, b, strict=True)}
    assert got == {(int(x), int(y)) for x in left for y in right if (int(x) ^ int(y)).bit_count() <= budget}


def test_components_of_a_crowd(spark):
    """A chain of fingerprints, each a bit from the next, with nodes cut into parts."""
    fps, x = [], 0
    for i in range(200):
        x ^= 1 << (i * 7 % 64)
        fps.append(x - (1 << 64) if x >> 63 else x)
    fps = sorted(set(fps)) + [0x5555555555555555]
    edges = simhash.trie_edges(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, node_rows=8)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups, todo = [], {f & (1 << 64) - 1 for f in fps}
    while todo:
        group, new = set(), {todo.pop()}
        while new:
            group |= new
            new = {y for y in todo for z in new if (y ^ z).bit_count() <= 2}
            todo -= new
        groups.append(group)
    found = {}
    for f in fps:
        found.setdefault(roots.get(f, f), set()).add(f & (1 << 64) - 1)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))


def test_near_duplicates_keep_the_smallest_id(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    rows = [(5, text), (3, text), (9, text + " end"), (1, "something else"), (7, ""), (8, None)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 2).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 7: 7, 8: 7}
    kept = simhash.without_near_duplicates(spark.createDataFrame([*rows, (3, text)], "doc_id long, text string"), 3, 2)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7]


# --- 10, repeats ---


def plain_repeats(rows, length):
    data = {d: (t or "").encode() for d, t in rows}
    first = {}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            first.setdefault(data[d][i : i + length], d)
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("seed,length", [(0, 50), (1, 50), (2, 37), (3, 50), (4, 50)])
def test_repeats_match_all_strings(spark, monkeypatch, seed, length):
    if seed == 4:
        monkeypatch.setattr(suffix, "CROWD", 2)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(6)] + ["xyz " * 40, "=" * 120]
    rows = []
    for i in range(60):
        parts = [rng.choice([" ".join(word() for _ in range(rng.randrange(20))), rng.choice(passages), rng.choice(passages)[: rng.randrange(20, 90)]]) for _ in range(rng.randrange(5))]
        rows.append((i * 3, rng.choice(["", " ", "\n"]).join(parts)))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_repeats(rows, length)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_longest_previous_factors_one_by_one():
    rng = random.Random(2)
    for _ in range(40):
        least = rng.choice([5, 8, 9, 12, 17])
        contexts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(least, least + 25))) for _ in range(rng.randrange(1, 10))]
        contexts += [c[rng.randrange(3) :] for c in contexts if len(c) > least + 3 and rng.random() < 0.5]
        docs = np.array([rng.randrange(5) for _ in contexts])
        common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = {}
        for i, c in enumerate(contexts):
            for k in range(len(c) - least + 1):
                best = max((common(c[k:], d[m:]) for j, d in enumerate(contexts) if docs[j] < docs[i] for m in range(len(d))), default=0)
                want[i, k] = best if best >= least else 0
        owner, place, factor = suffix.longest_previous_factors(contexts, docs, least)
        assert dict(zip(zip(owner.tolist(), place.tolist()), factor.tolist(), strict=True)) == want
        hits = suffix.previous_factors(contexts, docs, least)
        assert {(i, k): bool(x) for i, row in enumerate(hits) for k, x in enumerate(row)} == {at: x > 0 for at, x in want.items()}


def test_repeats_of_rows_that_share_an_id(spark):
    p = " ".join(f"word{i}" for i in range(20))
    rows = [(1, p), (2, p + "A" * 4), (2, "B" * 200), (2, "B" * 200), (3, "B" * 60), (None, p)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = len(p)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == [(0, n, 0, 0), (1, n, 0, 0), (2, n + 4, n, 1), (2, 200, 0, 0), (2, 200, 0, 0), (3, 60, 60, 1)]


def test_large_keys_are_passed_on_in_parts(monkeypatch):
    """What _sorted_out() says of runs in order, whatever the size of batches and of held rows."""
    import pyarrow as pa

    rng = random.Random(9)
    rows = sorted((rng.randrange(4), rng.randrange(12), rng.randrange(9), 0, rng.randrange(1000), 3, (rng.randrange(5) << 16) | rng.randrange(5), False) for _ in range(400))
    names = ["key", "whole", "doc_id", "who", "at", "n", "sides", "known"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def told(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), types, strict=True)], names=names) for i in range(0, len(rows), size)]
        return {tuple(r.values()) for b in suffix._sorted_out(iter(batches)) for r in b.to_pylist()}

    whole = told(400)
    assert whole == told(7)
    monkeypatch.setattr(suffix, "HELD_ROWS", 20)
    real = suffix.key_groups
    monkeypatch.setattr(suffix, "key_groups", lambda b, columns, most: real(b, columns, 10, most))
    parts = told(7)
    assert {r for r in whole if r[5] == 1} == {r for r in parts if r[5] == 1}
    assert {r for r in whole if r[5] == 2} <= {r for r in parts if r[5] == 2}


# --- the pipeline ---


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_pipeline_stage_by_stage(spark, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF).cache()
        assert out.columns == docs.columns, name
        if name == "language_id":
            assert rows.join(out, "doc_id", "left_anti").where(F.length(F.regexp_replace("text", r"[^a-z]", "")) > 20).count() == 0
        if name == "simhash_near_dedup":
            # against all pairs, compared exactly: whoever goes is similar to one that stays or goes, and nobody who stays is similar to another
            sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows.collect()}
            left = {r["doc_id"] for r in out.collect()}
            pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert set(sets) - left <= {b for _, b in pairs}
            assert not [p for p in pairs if set(p) <= left]
        if name == "mix_sources":
            want = mixing.mix_sources(rows).where("copies > 0").select("doc_id", "copies")
            assert sorted(map(tuple, want.collect())) == sorted(map(tuple, out.groupBy("doc_id").count().collect()))
        rows = out
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert packed.where("piece = 0").count() == rows.count()


@pytest.mark.parametrize("module,f", [(simhash, simhash.without_near_duplicates), (mixing, mixing.mixed_documents), (line_dedup, line_dedup.without_repeated_lines)])
@pytest.mark.parametrize("fetched", [True, False])
def test_rows_are_kept_when_files_are_split_anew(spark, monkeypatch, module, f, fetched):
    """As when executors come or go: reads after the decision have other partitions than those before it. fetched: else Spark joins the decisions."""
    size = "spark.sql.files.maxPartitionBytes"
    docs = table(spark, SF, "documents")
    want = sorted((r["doc_id"], r["text"] or "") for r in f(docs).select("doc_id", "text").collect())
    real, was = module.beside, spark.conf.get(size)
    if not fetched:
        from pyarrow.fs import FileSystem

        class Closed(FileSystem):
            @staticmethod
            def from_uri(uri):
                raise ValueError(uri)

        monkeypatch.setattr("pyarrow.fs.FileSystem", Closed)

    def beside(*args):
        spark.conf.set(size, "10k")
        return real(*args)

    monkeypatch.setattr(module, "beside", beside)
    try:
        got = sorted((r["doc_id"], r["text"] or "") for r in f(table(spark, SF, "documents")).select("doc_id", "text").collect())
    finally:
        spark.conf.set(size, was)
    assert got == want


def test_ids_at_both_ends_of_long(spark):
    rows = [(i, f"word{k % 7} " * (k + 1), "en", "a" if k % 2 else None, 0) for k, i in enumerate([1 << 60, -(1 << 60), (1 << 63) - 1, -(1 << 63), 0])]
    for f in OPERATORS.values():
        assert f(spark.createDataFrame(rows, DOCS)).count() >= 0
    assert {r["doc_id"] for r in mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()} == {r[0] for r in rows}


def test_a_column_named_like_sparks_own(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y")], "doc_id long, text string, _metadata string")
    assert sorted(map(tuple, simhash.without_near_duplicates(df).collect())) == [(1, "a b c d", "x")]


def test_folds_split_by_crc(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 25, -3)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", fold(F.col("doc_id"), 5).alias("f")).collect():
        assert r["f"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5
