"""Personal information inside free text: a skip-chain conditional random field over candidates.

Each candidate of pii_patterns is a node with the labels real and not real. Its
potential is a log-linear function of its form, its letters and its
surroundings. Linear edges join neighbours on a line; skip edges join distant
candidates of a document that repeat each other or are similar: the same text,
the same surname, number or street with another given name, prefix or house
number, and a surname that an e-mail address contains. A mention in a telling
place thus helps one in a bare place. Marginals come from loopy belief
propagation; candidates above one half are kept.

Given names and common words are counted over all documents. The weights of
nodes and edges are fitted together, by pseudo-likelihood, where the operator
runs: on a sample of documents of bounded size, labelled by the few places that
are sure (a field named "holder", "phone" and so on; words too common to be a
surname). A node's neighbours count with their labels or, where those are not
known, with their marginals under the weights of the round before. Parts of the
features are left out in turn, so that forms, letters, places and edges each
learn to decide without the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.llm.pii_patterns import ADDRESS, EMAIL, IDENTITY, NAME, PHONE, Candidate, candidates, tokens
from lodeflow.session import ensure_checkpoint_dir

#: Documents the model is fitted on, at most.
SAMPLE_DOCS = 6000
ROUNDS, DAMPING = 12, 0.5
PLACEHOLDERS = {NAME: "<NAME>", EMAIL: "<EMAIL>", PHONE: "<PHONE>", IDENTITY: "<IDENTITY_NUMBER>", ADDRESS: "<STREET_ADDRESS>"}

#: Places that are sure to hold a kind, as the text before it ends.
SURE = {
    NAME: re.compile(r"(?:\bholder[\"']?: ?[\"']?|@author |\bAuthor: |\bReviewed-by: |\b(?:maintainer|owner) ?[=:] ?[\"']?)$"),
    PHONE: re.compile(r"(?:phone[\"']?\W{1,4}|\btel[.:]+ ?|\bcall |\bfax |\bdesk |\bhours )$", re.IGNORECASE),
    IDENTITY: re.compile(r"(?:national_id[\"']?: ?[\"']|\bident: '?|\bssn\W{1,3}|\btin\W{1,3}|passport (?:no\. )?|\bnational id |steuer.id\W{1,2}|personnummer |\bpnr: |\bdni:? |\bnino\W{1,2}|security no\. |taxpayer id |card no\. |Reisepass )$", re.IGNORECASE),
    EMAIL: re.compile(r"(?:\bmail[\"']?: ?[\"']?|mailto:|\bbugs to )$"),
    ADDRESS: re.compile(r"(?:\bhome[\"']?: ?[\"']?|\blives at |\boffice: )$"),
}
#: Places that are sure to hold something else.
NEVER = {
    EMAIL: (re.compile(r"(?:://\S*|\bclone(?: from)? )$"), re.compile(r"^(?::[\w./~-]+|/)")),
    PHONE: (re.compile(r"(?:\border no\. |\bchecksum |\blot |\bisbn |\brun #|\bheight |\bsection |\bversion )$", re.IGNORECASE), None),
    IDENTITY: (re.compile(r"(?:\border no\. |\bchecksum |\blot |\bisbn |\brun #|\bheight |\bwindow |\bto |\w ?[=+*<>]=? )$", re.IGNORECASE), None),
}
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_LETTERS_ONLY = re.compile(r"[\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]{2,}")


@dataclass
class Model:
    lexicon: frozenset[str] = frozenset()
    weights: dict[str, float] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    #: How often each given name stands in a sure place.
    counts: Mapping[str, int] = field(default_factory=dict)
    #: Log-odds of equal labels for each type of edge.
    links: Mapping[str, float] = field(default_factory=dict)
    _trie: object = None

    @property
    def trie(self):
        if self._trie is None and self.lexicon:
            import ahocorasick

            self._trie = ahocorasick.Automaton()
            for w in sorted(self.lexicon):
                self._trie.add_word(w, w)
            self._trie.make_automaton()
        return self._trie

    def __getstate__(self):
        return self.__dict__ | {"_trie": None}


def _line(text: str, c: Candidate, width: int = 48) -> tuple[str, str]:
    """What stands before and after a candidate on its line."""
    a, b = max(0, c.start - width), min(len(text), c.end + width)
    return text[a : c.start].rpartition("\n")[2], text[c.end : b].partition("\n")[0]


def _mask(word: str) -> str:
    return "9" if word.isdigit() else word.lower()


def features(text: str, c: Candidate, model: Model) -> tuple[list[str], list[str]]:
    """Features of the candidate's letters, and of its surroundings."""
    k = c.kind[0] + ":"
    own = [k + "form=" + c.form, k]
    if c.kind == NAME:
        s = c.core.rpartition(" ")[2]
        last = s.rpartition("-")[2]
        own += [f"{k}end3={last[-3:]}", f"{k}end4={last[-4:]}", f"{k}top3={s[:3]}", f"{k}top4={s[:4]}", f"{k}long={min(len(s), 9)}"]
        shown = text[c.start : c.end]
        own.append(k + "case=" + ("upper" if shown.isupper() else "title" if all(w[:1].isupper() for w in shown.split()) else "lower" if shown.islower() else "mixed"))
        if s in model.common:
            own += [k + "common", f"{k}common={c.form}"]
        own.append(f"{k}parts={min(shown.count(' '), 3)}")
    before, after = _line(text, c)
    if c.given and model.counts:
        # Sure places besides the candidate's own, else a rare name would always be one of a sure place.
        elsewhere = max(0, model.counts.get(c.given, 0) - bool(SURE[NAME].search(before)))
        if elsewhere < 8:
            own.append(f"{k}rare={elsewhere.bit_length()}")
    left = [_mask(w) for w in _WORD.findall(before)[-3:]]
    right = [_mask(w) for w in _WORD.findall(after)[:2]]
    left = ["^"] * (3 - len(left)) + left
    right += ["$"] * (2 - len(right))
    around = [f"{k}l1={left[2]}", f"{k}l2={left[1]} {left[2]}", f"{k}l3={left[0]} {left[1]} {left[2]}", f"{k}r1={right[0]}", f"{k}r2={right[0]} {right[1]}", f"{k}lr={left[2]} {right[0]}", k + "lc=" + (before[-1:] or "^") + (after[:1] or "$")]
    if c.kind == EMAIL:
        around += [k + "url"] * ("://" in before.rpartition(" ")[2]) + [k + "path"] * bool(re.match(r":[\w.~-]", after))
    return own, around


def sure_label(text: str, c: Candidate, model: Model) -> int | None:
    """1 or 0 where a rule is sure of it, else None."""
    before, after = _line(text, c)
    if c.kind in NEVER:
        bad_before, bad_after = NEVER[c.kind]
        if bad_before.search(before) or (bad_after and bad_after.search(after)):
            return 0
    if SURE[c.kind].search(before):
        return 1
    if c.kind == NAME and c.core.rpartition(" ")[2] in model.common:
        return 0
    return None


def harvest_counts(texts: Sequence[str]) -> tuple[dict[str, int], frozenset[str]]:
    """Given names and how often they stand in sure places; and words too common to be surnames, from all documents."""
    first, seen, last = Counter(), Counter(), Counter()
    place = re.compile(r"(?:\bholder[\"']?: ?[\"']?|@author |\bAuthor: |\bReviewed-by: |\b(?:maintainer|owner) = [\"']?)([^\W\d_][^\n\"'<>(;/*@|{}]{4,60})")
    for t in texts:
        for m in place.finditer(t):
            who = m[1].strip().rstrip(".")
            last.update(w.lower() for w in _LETTERS.findall(who))
            if "," in who:
                who = who.partition(",")[2].strip()
            w = who.split(" ")[0].lower()
            if len(w) > 1 and re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", w) and " " in m[1].strip():
                first[w] += 1
        seen.update({w.lower() for w in _LETTERS.findall(t)})
    often = max(5, len(texts) // 500)
    # A frequent word that often stands where names stand may be a surname after all.
    return dict(first), frozenset(w for w, n in seen.items() if n >= often and last[w] < 0.1 * n) - first.keys()


def harvest(texts: Sequence[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Given names, from sure places; and words too common to be surnames, from all documents."""
    first, common = harvest_counts(texts)
    return frozenset(first), common


#: A word counts as common from this share of the documents on, which bounds the list's length. A given name counts from its first sure place on, in a corpus of any size.
COMMON_SHARE = 1 / 500
#: Given names that are sent to the executors as a whole, at most; a longer list is joined to the words of the texts.
GIVEN_BROADCAST = 200_000


def corpus_tables(docs: DataFrame, text: str) -> tuple[DataFrame, frozenset[str]]:
    """What harvest_counts() gives, counted over all documents where they lie; the given names as a table of g and n."""
    spark = docs.sparkSession
    t = docs.select(F.col(text).alias("t")).where(F.length("t") > 0)
    n = t.count()
    if not n:
        return spark.createDataFrame([], "g string, n bigint"), frozenset()
    place = r"""(?:\bholder["']?: ?["']?|@author |\bAuthor: |\bReviewed-by: |\b(?:maintainer|owner) = ["']?)(\p{L}[^\n"'<>(;/*@|{}]{4,60})"""
    who = t.where(F.col("t").rlike("holder|@author|Author: |Reviewed-by: |maintainer|owner")).select(F.explode(F.regexp_extract_all("t", F.lit(place), F.lit(1))).alias("w")).select(F.rtrim(F.btrim("w"), F.lit(".")).alias("w"))
    # Kept, as the few names serve three counts and the texts should be searched for them once.
    ensure_checkpoint_dir(spark)
    who = who.checkpoint()
    after = F.when(F.instr("w", ",") > 0, F.trim(F.regexp_replace("w", "^[^,]*,", ""))).otherwise(F.col("w"))
    first = who.where(F.instr("w", " ") > 0).select(F.lower(F.substring_index(after, " ", 1)).alias("g")).where(F.col("g").rlike(r"^\p{L}+(?:-\p{L}+)*$") & (F.length("g") > 1)).groupBy("g").agg(F.count("*").alias("n")).checkpoint()
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 2)
    seen = t.select(F.explode(F.array_distinct(split("t"))).alias("w"), F.lit(1).alias("d"), F.lit(0).alias("s"))
    last = who.select(F.explode(split("w")).alias("w"), F.lit(0).alias("d"), F.lit(1).alias("s"))
    counts = seen.unionByName(last).groupBy("w").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    often = counts.where((F.col("d") >= F.lit(max(5, n * COMMON_SHARE))) & (F.col("s") < 0.1 * F.col("d")))
    return first, frozenset(r.w for r in often.join(first, F.col("w") == F.col("g"), "left_anti").select("w").collect())


def corpus_words(docs: DataFrame, text: str) -> tuple[frozenset[str], frozenset[str]]:
    """What harvest() gives, counted over all documents where they lie."""
    given, common = corpus_tables(docs, text)
    return frozenset(r.g for r in given.select("g").collect()), common


#: Types of edges: neighbours on a line, the same text, something similar, a surname and an e-mail address with it.
LINKS = ("near", "same", "similar", "mail")
#: Which parts of a node's potential a training row has: own features, surroundings, edges.
PARTS = ((1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0))
MOST_LINK = 4.0


def fit_weights(rows: list[tuple[list[str], list[str], Sequence[float], int]], rounds: int = 120, ridge: float = 1.0) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of features and of edge types by logistic regression over (own features, surroundings, pull of the neighbours by type, label).

    With the neighbours' labels given, this is the pseudo-likelihood of the field.
    """
    index: dict[str, int] = {}
    flat, at, pulls, y = [], [], [], []
    for own, around, pull, label in rows:
        for parts in PARTS:
            if parts[2] and not any(pull) and parts != (1, 1, 1):
                continue
            at.append(len(flat))
            flat += [index.setdefault(f, len(index)) for f in (own if parts[0] else own[1:2]) + (around if parts[1] else [])]
            pulls.append(pull if parts[2] else (0.0,) * len(LINKS))
            y.append(label)
    if not y or len(set(y)) < 2:
        return {}, {}
    f, start, x, y = np.array(flat), np.array(at), np.array(pulls, dtype=float), np.array(y, dtype=float)
    row = np.repeat(np.arange(len(y)), np.diff([*start, len(f)]))
    w, scale = np.zeros(len(index)), np.full(len(index), 1e-6)
    v, vscale = np.zeros(len(LINKS)), np.full(len(LINKS), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[f], start) + x @ v, -30, 30)))
        g = np.bincount(f, weights=(p - y)[row], minlength=len(index)) + ridge * w
        scale += g * g
        w -= 0.5 * g / np.sqrt(scale)
        g = x.T @ (p - y) + ridge * v
        vscale += g * g
        # Edges attract; a bound keeps one pair from outweighing everything.
        v = np.clip(v - 0.5 * g / np.sqrt(vscale), 0.0, MOST_LINK)
    return {k: float(w[i]) for k, i in index.items() if abs(w[i]) > 1e-3}, dict(zip(LINKS, map(float, v), strict=True))


def _keys(c: Candidate, shown: str) -> list[tuple[str, object]]:
    """What a candidate shares with those it is linked to, by type of edge."""
    keys = [("same", (c.kind, shown))]
    if c.kind == NAME:
        keys += [("similar", c.core.rpartition(" ")[2]), ("mail", c.core.rpartition(" ")[2].rpartition("-")[2])]
    elif c.kind in (PHONE, IDENTITY):
        keys.append(("similar", c.core[-7:]))
    elif c.kind == ADDRESS:
        keys.append(("similar", _LETTERS_ONLY.sub(" ", c.core).strip()))
    else:
        keys += [("mail", w) for w in set(_LETTERS.findall(c.core.partition("@")[0])) if len(w) > 2]
    return keys


def edges(text: str, found: Sequence[Candidate]) -> list[tuple[int, int, str]]:
    """Linear edges between neighbours on a line, and skip edges to the last mention of the same or of something similar."""
    out, last = [], {}
    for i, c in enumerate(found):
        b = found[i - 1] if i else None
        if b and b.end <= c.start and c.start - b.end < 80 and "\n" not in text[b.end : c.start]:
            out.append((i - 1, i, "near"))
        joined: set[int] = set()
        for kind, key in _keys(c, text[c.start : c.end].lower()):
            other = last.get((kind, key))
            # Forms that overlap are readings of one mention, not two mentions.
            if other is not None and other not in joined and found[other].end <= c.start and (kind != "mail" or (found[other].kind == EMAIL) != (c.kind == EMAIL)):
                out.append((other, i, kind))
                joined.add(other)
            last[kind, key] = i
    return out


def _softplus(x: float) -> float:
    return x if x > 30 else math.log1p(math.exp(x))


def marginals(logits: Sequence[float], links: Sequence[tuple[int, int, float]], rounds: int = ROUNDS) -> list[float]:
    """Loopy sum-product on binary nodes; a link's weight is the log-odds of equal labels."""
    inbox: dict[int, dict[int, float]] = defaultdict(dict)
    for n, (i, j, _) in enumerate(links):
        inbox[j][n] = 0.0
        inbox[i][-n - 1] = 0.0
    for _ in range(rounds if links else 0):
        moved = 0.0
        for n, (i, j, w) in enumerate(links):
            for a, b, to, back in ((i, j, n, -n - 1), (j, i, -n - 1, n)):
                h = logits[a] + sum(inbox[a].values()) - inbox[a][back]
                new = _softplus(w + h) - w - _softplus(h - w)
                new = DAMPING * inbox[b][to] + (1 - DAMPING) * new
                moved = max(moved, abs(new - inbox[b][to]))
                inbox[b][to] = new
        if moved < 1e-3:
            break
    beliefs = (x + sum(inbox[i].values()) if i in inbox else x for i, x in enumerate(logits))
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, b)))) for b in beliefs]


def _score(feats: tuple[list[str], list[str]], model: Model) -> float:
    w = model.weights
    return sum(w.get(f, 0.0) for part in feats for f in part)


def _logit(text: str, c: Candidate, model: Model) -> float:
    return _score(features(text, c, model), model)


def _pulls(n: int, links: Sequence[tuple[int, int, str]], p: Sequence[float]) -> list[list[float]]:
    """For each node and type of edge, how far its neighbours are for 1 rather than 0."""
    out = [[0.0] * len(LINKS) for _ in range(n)]
    for i, j, kind in links:
        k = LINKS.index(kind)
        out[i][k] += 2 * p[j] - 1
        out[j][k] += 2 * p[i] - 1
    return out


def train(texts: Sequence[str], words: tuple[Mapping[str, int], frozenset[str]] | None = None, rounds: int = 3) -> Model:
    """A model from unlabelled texts (one that goes by forms alone, if there are none). words: given names with their counts and common words, else those of the texts."""
    given, common = harvest_counts(texts) if words is None else words
    model = Model(lexicon=frozenset(given), common=common, counts=given)
    docs = []
    for t in texts:
        found = candidates(t, model.trie, model.lexicon)
        if found:
            docs.append((edges(t, found), [features(t, c, model) for c in found], [sure_label(t, c, model) for c in found]))
    for turn in range(rounds):
        rows = []
        for links, feats, labels in docs:
            if not any(y is not None for y in labels):
                continue
            # In the first round, neighbours without a label don't pull.
            logits = [_score(f, model) for f in feats]
            held = [12.0 * (2 * y - 1) if y is not None else x for x, y in zip(logits, labels, strict=True)]
            p = marginals(held, [(i, j, model.links.get(k, 0.0)) for i, j, k in links]) if turn else [0.5 if y is None else y for y in labels]
            pulls = _pulls(len(feats), links, p)
            rows += [(*f, x, y) for f, x, y in zip(feats, pulls, labels, strict=True) if y is not None]
        weights, ties = fit_weights(rows)
        if not weights:
            break
        model.weights, model.links = weights, ties
    if not model.weights:
        # Too few labelled candidates, or all of them alike: forms and lists decide.
        model.weights = {k[0] + ":": 1.0 for k in (EMAIL, PHONE, IDENTITY, ADDRESS, NAME)}
    return model


def find(text: str, model: Model) -> list[Candidate]:
    """The personal information of one text, in order, without overlaps."""
    found = candidates(text, model.trie, model.lexicon)
    if not found:
        return []
    links = [(i, j, model.links[k]) for i, j, k in edges(text, found) if model.links.get(k)]
    logits = [_logit(text, c, model) for c in found]
    # A message is never stronger than its link: where all nodes outweigh their links, no label can change.
    pull = [0.0] * len(found)
    for i, j, w in links:
        pull[i] += w
        pull[j] += w
    p = marginals(logits, links if any(abs(x) <= y for x, y in zip(logits, pull, strict=True) if y) else [])
    kept = [(c, x) for c, x in zip(found, p, strict=True) if x > 0.5]
    out: list[tuple[Candidate, float]] = []
    for c, x in kept:
        # Of two that overlap, the outer one counts; of two that cross, the likelier.
        clash = [o for o in out[-3:] if o[0].end > c.start]
        if any(o[0].start <= c.start and o[0].end >= c.end for o in clash):
            continue
        inner = [o for o in clash if c.start <= o[0].start and o[0].end <= c.end]
        if all(o in inner or x > o[1] for o in clash):
            out = [o for o in out if o not in clash] + [(c, x)]
    return [c for c, _ in out]


def sample_texts(docs: DataFrame, key: str, text: str, n: int = SAMPLE_DOCS) -> list[str]:
    """At most n whole texts, chosen by the hash of their key."""
    rows = docs.where(F.col(text).isNotNull())
    total = rows.count()
    if not total:
        return []
    chosen = rows if total <= n else rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < F.lit(int((1 << 30) * n / total)))
    return [r[0] for r in chosen.select(text).orderBy(F.xxhash64(text)).limit(n).collect()]


def fitted(docs: DataFrame, key: str, text: str, most: int | None = None) -> tuple[Model, DataFrame | None]:
    """A model of the documents; and the table of given names, where they are more than `most` and the model has those of the sample only."""
    texts = sample_texts(docs, key, text)
    given, common = corpus_tables(docs, text)
    long = given.count() > (GIVEN_BROADCAST if most is None else most)
    mine = given
    if long:
        words = docs.sparkSession.createDataFrame(pd.DataFrame({"g": sorted({w for t in texts for w in tokens(t)})}, dtype=str), "g string")
        mine = given.join(words, "g", "left_semi")
    return train(texts, ({r.g: r.n for r in mine.collect()}, common)), given if long else None


def with_given(docs: DataFrame, text: str, given: DataFrame | None) -> DataFrame:
    """docs with _given: the given names among the words of each text, by a join; NULL without a table of names. Equal texts share their words."""
    kind = "array<struct<g:string,n:bigint>>"
    if given is None:
        return docs.withColumn("_given", F.lit(None).cast(kind))
    at = {"_a": F.xxhash64(text), "_b": F.xxhash64(F.lit("given"), text)}

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple[int, int, str]] = []
            for x, y, t in zip(b["_a"], b["_b"], b["_t"], strict=True):
                out += [(x, y, w) for w in sorted(tokens(t))]
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=["_a", "_b", "g"])
                    out = []
            yield pd.DataFrame(out, columns=["_a", "_b", "g"])

    words = docs.where(F.length(text) > 0).select(*[c.alias(k) for k, c in at.items()], F.col(text).alias("_t")).mapInPandas(split, "_a bigint, _b bigint, g string")
    held = words.join(given, "g").groupBy("_a", "_b").agg(F.collect_set(F.struct("g", "n")).alias("_given"))
    # An empty list, not NULL, for a text without given names.
    return docs.withColumns(at).join(held, ["_a", "_b"], "left").withColumn("_given", F.coalesce("_given", F.array().cast(kind))).drop("_a", "_b")


def _model_of(m: Model, given) -> Model:
    """The model with the given names of one text, if they came by a join."""
    if given is None:
        return m
    counts = {x["g"]: x["n"] for x in given}
    return replace(m, lexicon=frozenset(counts), counts=counts, _trie=None)


def find_all(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, start_char, end_char, kind: every piece found, by code points. NULL and empty texts have none. Whole texts are read."""
    model, given = fitted(docs, key, text) if model is None else (model, None)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, start_char int, end_char int, kind string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = [(k, c.start, c.end, c.kind) for k, t, g in zip(b[key], b[text], b["_given"], strict=True) for c in find(t, _model_of(m, g))]
            yield pd.DataFrame(rows, columns=[key, "start_char", "end_char", "kind"])

    return with_given(docs.where(F.length(text) > 0).select(key, text), text, given).mapInPandas(run, schema)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """key and text with every piece replaced by a placeholder of its kind; all else as it was. NULL stays NULL."""
    model, given = fitted(docs, key, text) if model is None else (model, None)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, `{text}` string, n_replaced int"

    def clean(t: str | None, m: Model) -> tuple[str | None, int]:
        pieces, at, found = [], 0, find(t, m) if t else []
        for c in found:
            pieces += [t[at : c.start], PLACEHOLDERS[c.kind]]
            at = c.end
        return (t if not found else "".join(pieces) + t[at:]), len(found)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            done = [clean(t, _model_of(m, g)) for t, g in zip(b[text], b["_given"], strict=True)]
            yield pd.DataFrame({key: b[key], text: [x for x, _ in done], "n_replaced": [n for _, n in done]})

    return with_given(docs.select(key, text), text, given).mapInPandas(run, schema)
