import math
import random
import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeflow.llm import pii_patterns as patterns
from lodeflow.llm.pii import Model, corpus_words, edges, find, find_all, harvest, marginals, redact, sample_texts, train
from lodeflow.llm.pii_patterns import ADDRESS, EMAIL, IDENTITY, NAME, PHONE, candidates

GIVEN = ["Arvo", "Belen", "Cosima", "Dario", "Elke", "Fenno", "Greta", "Hanno", "Iris", "Jori"]
START, END = ["Kar", "Lom", "Mir", "Nost", "Ost", "Pra", "Ruv", "Sel", "Tarn", "Umb"], ["dalen", "vasto", "kainen", "bergo", "lund", "mazzi", "rova", "stead"]
PLAIN = ["open the ledger before the queue", "match the Main Thread again", "retry twice, then stop", "the cache is cold today", "see section 5.17.10, table 5"]
FACTS = {
    IDENTITY: ["912-45-0227", "QQ 12 34 56 C", "06 678 955 429", "0394 6839 4861", "421926-7618", "69347297-F", "X00432569"],
    PHONE: ["+44 20 7946 0048", "(690) 555-0123", "215-555-0139", "01 99 00 81 38", "030/23125-382", "07700 900481", "1-487-555-0111 ext. 43"],
    ADDRESS: ["83 Rushden Lane", "Calle Quarrel, 45", "Ostraustr. 42", "50 bis, avenue de Yarrow", "Flat 5, 24 Birkenau Road"],
    EMAIL: ["a.b@mail.example.org", "x5 [at] eng [dot] example [dot] com", "k.l%40lantern.example", "m_n at harbour dot test"],
}


def corpus(n, seed):
    """Texts and where the pieces are: (start, kind)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, truth = "", []

        def put(before, kind, value, after):
            nonlocal text
            truth.append((len(text) + len(before), kind))
            text += before + value + after

        def who():
            g, s = rng.choice(GIVEN), rng.choice(START) + rng.choice(END)
            return rng.choice([f"{g} {s}", f"{g} {s}", f"{s}, {g}", f"{g[0]}. {s}", f"{g} {s}".upper()])

        for _ in range(rng.randrange(2, 7)):
            text += rng.choice(PLAIN) + "\n"
            k = rng.randrange(8)
            if k < 2:
                put(rng.choice(["// Author: ", "  holder: ", "# @author "]), NAME, who(), "\n")
            elif k == 2:
                put(rng.choice(["// thanks to ", "// run by "]), NAME, who(), " for it\n")
            elif k == 3:
                put('  "phone": "', PHONE, rng.choice(FACTS[PHONE]), '"\n')
            elif k == 4:
                put("  ident: '", IDENTITY, rng.choice(FACTS[IDENTITY]), "'\n")
            elif k == 5:
                put("  mail: ", EMAIL, rng.choice(FACTS[EMAIL]), "\n")
            elif k == 6:
                put("  home: ", ADDRESS, rng.choice(FACTS[ADDRESS]), "\n")
            else:
                text += rng.choice(["clone git@forge.example:core/ledger.git\n", "// the Iris Cache step comes last\n", "decorated with @open.read\n", "pin left-pad@1.2.3\n"])
        out.append((text, truth))
    return out


@pytest.fixture(scope="module")
def model():
    return train([t for t, _ in corpus(1500, 1)])


def test_held_out_accuracy(model):
    hit = made = true = 0
    for text, truth in corpus(400, 2):
        found = {(c.start, c.kind) for c in find(text, model)}
        hit, made, true = hit + len(found & set(truth)), made + len(found), true + len(truth)
    assert hit / made > 0.97 and hit / true > 0.97


def exact(logits, links):
    n, out, z = len(logits), [0.0] * len(logits), 0.0
    for m in range(1 << n):
        y = [m >> i & 1 for i in range(n)]
        w = math.exp(sum(x for x, v in zip(logits, y) if v) + sum(k for i, j, k in links if y[i] == y[j]))
        z += w
        out = [o + w * v for o, v in zip(out, y)]
    return [o / z for o in out]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=2, max_size=7), st.floats(0, 2), st.data())
def test_propagation_is_exact_on_trees(logits, weight, data):
    links = [(data.draw(st.integers(0, j - 1)), j, weight) for j in range(1, len(logits))]
    assert marginals(logits, links, 60) == pytest.approx(exact(logits, links), abs=2e-3)


def test_skip_edges_carry_evidence():
    lone, tied = marginals([3.0, -0.5], []), marginals([3.0, -0.5], [(0, 1, 2.0)])
    assert lone[1] < 0.5 < tied[1]


def test_forms_and_places(model):
    cases = {
        "// mailto:a.b@x.example?subject=y": [(10, EMAIL)], "// tel:+44 20 7946 0048": [(7, PHONE)], "// ask (020 7946 0599)": [(8, PHONE)],
        "  home: Flat 5, 24 Birkenau Road, Upper Town": [(8, ADDRESS)], "postgres://svc:pw12@db.example.org/main": [], "clone git@forge.example:core/x.git": [],
    }
    for text, want in cases.items():
        assert [(c.start, c.kind) for c in find(text, model)] == want, text


def test_redaction_keeps_the_rest(spark, model):
    texts = [t for t, _ in corpus(30, 5)] + [None, "", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' as kind")
    out = {r.doc_id: r.text for r in redact(df, model=model).collect()}
    places = {}
    for r in find_all(df, model=model).collect():
        places.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.kind))
    for i, t in enumerate(texts):
        if t is None:
            assert out[i] is None
            continue
        rest, at = "", 0
        for a, b, k in sorted(places.get(i, [])):
            rest += t[at:a] + {"name": "<NAME>", "email": "<EMAIL>", "phone": "<PHONE>", "identity_number": "<IDENTITY_NUMBER>", "street_address": "<STREET_ADDRESS>"}[k]
            at = b
        assert out[i] == rest + t[at:]


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert find_all(df).count() == 0 and sample_texts(df, "doc_id", "text") == []
    assert find("bugs to a@b.example", train([]))
    one = spark.createDataFrame([(None, "bugs to a@b.example"), (2, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.start_char) for r in find_all(one).collect()] == [(None, 8)]


@pytest.mark.parametrize("unit", ["a", "1", " ", "a.b@", "+1 ", "A. ", "0x", "ß, İ ", "12 Ab ", "Iris ", "(at) ", "-", "\n"])
def test_long_texts_in_linear_time(model, unit):
    text = unit * (400_000 // len(unit))
    began = time.time()
    find(text, model)
    assert time.time() - began < 20


def test_no_model_needed_for_candidates():
    assert [c.kind for c in candidates("mail x@y.example", None, frozenset())] == [EMAIL]
    assert isinstance(Model().trie, type(None))


def test_corpus_words_are_those_of_all_texts(spark):
    texts = [t for t, _ in corpus(1200, 8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "doc_id bigint, text string")
    assert corpus_words(df, "text") == harvest(texts)
    assert corpus_words(df.limit(0), "text") == (frozenset(), frozenset())


def test_a_rare_given_name_counts_in_a_large_corpus(spark):
    texts = [t for t, _ in corpus(1200, 8)] + ["// Author: Quillon Karlund\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert "quillon" in corpus_words(df, "text")[0] and "quillon" in harvest(texts)[0]


def test_a_long_list_of_given_names_is_joined(spark, monkeypatch):
    texts = [t for t, _ in corpus(300, 9)] + ["nothing here", "", None]
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    run = lambda: (sorted(map(tuple, find_all(df).collect()), key=str), sorted(map(tuple, redact(df).collect()), key=str))
    whole = run()
    monkeypatch.setattr("lodeflow.llm.pii.GIVEN_BROADCAST", 2)
    assert run() == whole and whole[0]


@pytest.mark.parametrize("text", [
    *[f"12 Long {w}" for w in patterns._STREETS.split("|")], *[f"12 {w} des Tilleuls" for w in patterns._FRENCH.replace("all[ée]e", "allée|allee").split("|")], "7 bis, cours Mirabeau",
    *[f"{w} Mayor, 5" for w in patterns._SPANISH.replace("\\", "").split("|")], *[f"Stor{w} 12" for w in patterns._GERMAN.replace("\\", "").split("|")], *[f"{w} Linden 5" for w in patterns._AM.split("|")],
])
def test_every_form_of_address_alone(text):
    assert [(c.kind, c.start, c.end) for c in candidates(text, None, frozenset()) if c.kind == ADDRESS] == [(ADDRESS, 0, len(text))]


def test_short_and_apostrophe_names_are_candidates(spark):
    texts = ["// Author: Bo Larsen\n", "// Author: Grace Ng\n", "// Author: Mei Li\n"]
    given = harvest(texts)[0]
    assert given == {"bo", "grace", "mei"} == corpus_words(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "text")[0]
    m = Model(lexicon=given)
    for who in ("Bo Larsen", "Grace Ng", "Mei Li", "J. O'Brien", "Mei O’Brien", "O'Brien, Mei", "Li, Mei"):
        assert (0, len(who)) in {(c.start, c.end) for c in candidates(who + " wrote it", m.trie, given) if c.kind == NAME}, who


def test_common_words_of_two_letters_are_no_surnames():
    texts = [t for t, _ in corpus(1500, 1)] + ["it is so\n"] * 40
    m = train(texts)
    assert {"it", "is", "so"} <= m.common and not find("// Iris is late", m)


def test_skip_edges_decide_bare_and_unlisted_mentions():
    """Ablation: a mention in a telling place carries the same name, and a relative whose given name is on no list, in bare places."""
    m = Model(lexicon=frozenset({"iris"}), weights={"n:": -1.0, "n:l2=author :": 6.0}, links={"same": 2.5, "similar": 2.5, "near": 0.0, "mail": 0.0})
    text = "// Author: Iris Karlund\nsee Brennoc Karlund again\nthen Iris Karlund\nand Iris Cache"
    names = lambda m: [text[c.start : c.end] for c in find(text, m)]
    assert names(m) == ["Iris Karlund", "Brennoc Karlund", "Iris Karlund"]
    assert names(replace(m, links={})) == ["Iris Karlund"]


def test_edge_weights_are_fitted_with_the_others():
    """Names that repeat within a text: their edges get a weight, and labels of the neighbours alone can decide."""
    rng = random.Random(3)
    texts = [t for t, _ in corpus(400, 1)]
    for _ in range(300):
        g, s = rng.choice(GIVEN), rng.choice(START) + rng.choice(END)
        texts.append(f"// Author: {g} {s}\nopen the ledger\n// Reviewed-by: {rng.choice([g, rng.choice(GIVEN)])} {s}\n// the Iris Cache step\nthen the Iris Cache\n")
    m = train(texts)
    assert m.links["same"] > 0.3 and m.links["similar"] > 0.3
    assert train(texts, rounds=1).links != m.links


def test_edges_join_what_repeats_or_resembles():
    text = "call +44 20 7946 0048\nIris Karlund\n020 7946 0048\nGreta Karlund <greta.karlund@mail.example>\n12 Ash Lane\n14 Ash Lane\nIris Karlund"
    m = Model(lexicon=frozenset({"iris", "greta"}))
    found = candidates(text, m.trie, m.lexicon)
    shown = {(text[found[i].start : found[i].end], text[found[j].start : found[j].end], k) for i, j, k in edges(text, found)}
    assert {("+44 20 7946 0048", "020 7946 0048", "similar"), ("Iris Karlund", "Greta Karlund", "similar"), ("Greta Karlund", "greta.karlund@mail.example", "mail"), ("12 Ash Lane", "14 Ash Lane", "similar"), ("Iris Karlund", "Iris Karlund", "same")} <= shown
    assert ("Greta Karlund", "greta.karlund@mail.example", "near") in shown


def test_a_corpus_too_small_to_fit_goes_by_forms_and_lists():
    texts = ["// Author: Iris Karlund\n", "holder: Dario Ostrova\nphone: +44 20 7946 0048\n"]
    m = train(texts)
    assert [c.kind for t in texts for c in find(t, m)] == [NAME, NAME, PHONE] and [c.kind for c in find("then Dario Selbergo", m)] == [NAME]
