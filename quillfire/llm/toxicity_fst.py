"""Toxicity: a weighted finite-state grammar over clauses.

Words are mapped to a small alphabet of classes (insult, threat, target,
negation, ...), and a paragraph, as a string of classes with its sentence ends,
is read by the composition of five transducers:

* negation, before an insult or threat or at the end of its clause, takes it out;
* reported speech takes out what is quoted or said by others, over sentence ends;
* threat joins modal and verb;
* target binds an insult to whom it is aimed at: a pronoun, or a determiner or
  copula that makes a phrase about somebody of it;
* verdict weighs what is left.

A document's score is the sum over its clauses.  A word by itself weighs
nothing, however often it stands: an insult counts where it is aimed, bound in a
phrase, or piled on another one in the same clause; a threat after its modal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quillfire.llm.common import by_id, labelled_sample, project, slices

# ---- transducers -----------------------------------------------------------
#: classes: Insult, Threat verb, target (Y), Determiner or copula, Negation, Reporting verb, E first person,
#: Quote mark, Modal, Function word, X other, S end of a sentence, L end of a line
#: made by the transducers: i, h negated; j, k reported; W a threat with its modal; of insults A aimed, B bound;
#: of what follows one: a a target of an unbound one, e of a bound one, d what binds it
ALPHABET = "ITYDNREQMFXSL"
SCOPE = 3  # words over which negation, modal and target reach
ENDS = "SL"


@dataclass
class Fst:
    """Deterministic weighted transducer: ``step(state, class)`` gives the classes
    written, a weight and the next state.  Arcs are made when they are first taken."""

    start: Hashable
    step: Callable
    arcs: dict = field(default_factory=dict)

    def arc(self, state: Hashable, given: str) -> tuple[str, float, Hashable]:
        if (found := self.arcs.get((state, given))) is None:
            found = self.arcs[state, given] = self.step(state, given)
        return found

    def run(self, classes: str) -> tuple[str, float]:
        """What is written, and the weight; classes end with an L to be complete."""
        state, out, total = self.start, [], 0.0
        for c in classes:
            o, w, state = self.arc(state, c)
            out.append(o)
            total += w
        return "".join(out), total


def compose(a: Fst, b: Fst) -> Fst:
    """Reads what ``a`` reads, writes what ``b`` writes of ``a``'s output."""

    def step(state, given):
        p, q = state
        mid, total, p = a.arc(p, given)
        out = ""
        for c in mid:
            o, w, q = b.arc(q, c)
            out += o
            total += w
        return out, total, (p, q)

    return Fst((a.start, b.start), step)


def negation() -> Fst:
    """An insult or threat is negated at most ``SCOPE`` words after a negation, where
    no content word lies between, and before a negation that ends the clause, with
    at most two words between, none of content (``an idiot he is not.``).

    State: (words that the last negation still reaches, what waits for its clause to go on).
    """

    def step(state, c):
        reach, held = state
        if held:
            if held[-1] != "N" and (c == "N" or c in "YDF" and len(held) < 3):
                return "", 0.0, (max(0, reach - 1), held + c)
            if held[-1] == "N" and c in "SLQ":
                return held[0].replace("I", "i").replace("T", "h") + held[1:] + c, 0.0, (0, "")
            reach = SCOPE if held[-1] == "N" else reach
            out, w, state = step((reach, ""), c)
            return held + out, w, state
        if c == "N":
            return c, 0.0, (SCOPE, "")
        if c in "YDFM":
            return c, 0.0, (max(0, reach - 1), "")
        if c in "IT":
            return ("", 0.0, (0, c)) if not reach else ({"I": "i", "T": "h"}[c], 0.0, (reach - 1, ""))
        return c, 0.0, (0, "")

    return Fst((0, ""), step)


def reporting() -> Fst:
    """What stands in quotation marks, which a line's end closes, or follows a
    reporting verb in its sentence, is somebody else's, unless the verb's subject
    is the first person.  State: "" own, "E" after the first person, "R", "Q"."""

    def step(state, c):
        if c == "L":
            return c, 0.0, ""
        if c == "Q":
            return c, 0.0, "" if state == "Q" else "Q"
        if state in ("Q", "R"):
            out = {"I": "j", "i": "j", "T": "k", "h": "k"}.get(c, c)
            return out, 0.0, "" if state == "R" and c == "S" else state
        if c == "E":
            return c, 0.0, "E"
        if c == "R":
            return c, 0.0, "" if state == "E" else "R"
        return c, 0.0, "E" if state == "E" and c in "MFN" else ""

    return Fst("", step)


def threats() -> Fst:
    """A threat verb is one only after a modal (``I will ...``).  State: words left
    in which it may follow."""

    def step(state, c):
        if c == "M":
            return c, 0.0, SCOPE
        if c == "T":
            return "W" if state else "X", 0.0, 0
        return c, 0.0, max(0, state - 1) if c in "YDFN" else 0

    return Fst(0, step)


def targets() -> Fst:
    """Binds insults: aimed (A) where a target stands at most ``SCOPE`` words
    before, bound (B) where a determiner or copula does; after an insult, a target
    or binding word at most so many words later is marked.

    State: (reach of the last target, of the last binder; the last insult: u unbound
    or b bound, its reach).
    """

    def step(state, c):
        near, binder, last, since = state
        near, binder, since = (max(0, n - 1) for n in (near, binder, since))
        last = last if since else ""
        if c == "Y":
            return {"u": "a", "b": "e"}.get(last, "Y"), 0.0, (SCOPE + 1, binder, "", 0)
        if c == "D":
            out, last = ("d", "b") if last == "u" else ("D", last)
            return out, 0.0, (near, SCOPE + 1, last, since)
        if c == "I":
            if near:
                return "A", 0.0, (near, binder, "", 0)
            return ("B", 0.0, (0, binder, "b", SCOPE + 1)) if binder else ("I", 0.0, (0, 0, "u", SCOPE + 1))
        if c in "SLQihjk":
            return c, 0.0, (0, 0, "", 0)
        return c, 0.0, (near, binder, last, since)

    return Fst((0, 0, "", 0), step)


AIMED, BOUND, PILED, THREAT, AT_TARGET, REPORTED = 1.5, 0.5, 1.0, 1.0, 1.0, 0.1


def verdict() -> Fst:
    """Weighs what is left.  State: (insults of the sentence so far, two at most;
    words in which a threat's object may follow)."""
    weights = {"A": AIMED, "a": AIMED, "e": AIMED - BOUND, "B": BOUND, "d": BOUND, "W": THREAT, "j": REPORTED, "k": REPORTED}

    def step(state, c):
        insults, reach = state
        w = weights.get(c, 0.0)
        if c in ENDS:
            return c, w, (0, 0)
        if c in "IAB":
            insults += insults < 2
            if (insults, state[0]) == (2, 1):
                w += PILED
        if c == "W":
            return c, w, (insults, SCOPE)
        if c in "Yae" and reach:
            return c, w + AT_TARGET, (insults, 0)
        return c, w, (insults, max(0, reach - 1))

    return Fst((0, 0), step)


def parts() -> list[Fst]:
    return [negation(), reporting(), threats(), targets(), verdict()]


@cache
def grammar() -> Fst:
    first, *rest = parts()
    for p in rest:
        first = compose(first, p)
    return first


# ---- lexicon ---------------------------------------------------------------
WORDS = {
    "I": "idiot idiots moron morons stupid imbecile scum trash loser losers pathetic worthless disgusting clown clowns dumb "
    "filthy vermin parasite parasites retard retarded bastard bastards bitch asshole jerk degenerate subhuman freak creep "
    "dummkopf trottel abschaum arschloch vollidiot wertlos erbärmlich connard salaud ordure abruti débile crétin "
    "idiota imbécil estúpido estúpida basura escoria asqueroso asquerosa inútil payaso",
    "T": "kill hurt murder shoot stab strangle töten umbringen tuer matar",
    "Y": "you your yours u he she they him them her thou du dich dir sie ihr ihn ihm euch tu te toi vous il elle ils elles "
    "lui usted ustedes tú ti él ella ellos ellas you're you've he's she's they're",
    "D": "the this that these those his their our my its is was are were be been being am of like as isn't aren't wasn't "
    "der die das den dem des dieser diese dieses ist sind war waren sein wie von dein deine euer eure "
    "le la les ce cet cette ces est sont était comme du de ton ta tes votre vos "
    "el los las ese esa este esta estos esas es son era eran como del tu tus su sus",
    "N": "not no never isn't aren't wasn't ain't don't doesn't didn't won't nobody nicht kein keine nie pas jamais nunca jamás",
    "R": "said says say wrote writes claimed claims called calls quoted reported reports alleged tweeted shouted told "
    "sagte schrieb behauptete nannte dit écrit affirmé appelé dijo escribió llamó",
    "E": "i we ich wir je j'ai nous yo nosotros",
    "M": "will would gonna shall should must could can going want wants i'll werde wird muss vais va veux voy quiero",
    "F": "a an and or to so such very really just all quite too in on at by for with from it what have has had "
    "ein eine einen und oder zu so sehr ganz nur auch un une et ou si très tout aussi en y o muy tan todo una con por para que "
    "absolute absolutely complete completely total totally utter utterly fucking damn",
}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”«»„]|[.!?;]+")


def words(stems: tuple[str, ...] = ()) -> tuple[dict[str, str], tuple[str, ...], re.Pattern]:
    """Class of each known word, the insulting stems, and a pattern without a
    match of which no line can score."""
    classes = {w: c for c, ws in reversed(WORDS.items()) for w in ws.split()}  # of two classes the first
    hits = sorted((w for w, c in classes.items() if c in "IT"), key=len, reverse=True)
    whole = r"(?<![^\W_])(?:" + "|".join(map(re.escape, hits)) + r")(?![^\W_])"
    begun = "|(?<![^\\W_])(?:" + "|".join(map(re.escape, sorted(stems, key=len, reverse=True))) + ")" if stems else ""
    return classes, stems, re.compile(whole + begun)


def classify(line: str, classes: dict[str, str], stems: tuple[str, ...]) -> str:
    """Classes of a line of lower-case text, with an L at its end."""
    out = []
    for w in TOKEN.findall(line):
        if w in '"“”«»„':
            out.append("Q")
        elif w[0] in ".!?;":
            out.append("S")
        elif c := classes.get(w.replace("’", "'")):
            out.append(c)
        else:
            out.append("I" if stems and w.startswith(stems) else "X")
    return "".join(out) + "L"


def score(text: str | None, lexicon) -> tuple[float, int]:
    """(score, clauses that scored) of a whole text."""
    classes, stems, hit = lexicon
    if not text:
        return 0.0, 0
    low = text.lower()
    total, n, machine, end = 0.0, 0, grammar(), 0
    arc = machine.arc
    for m in hit.finditer(low):
        if m.start() < end:
            continue  # in the line just read
        start = low.rfind("\n", 0, m.start()) + 1
        end = low.find("\n", m.end())
        end = len(low) if end < 0 else end
        state, clause = machine.start, 0.0
        for c in classify(low[start:end], classes, stems):
            out, w, state = arc(state, c)
            clause += w
            if clause and out and out[-1] in ENDS:
                total, n, clause = total + clause, n + 1, 0.0
    return round(total, 6), n


# ---- stems from labelled documents -------------------------------------------
def learn_stems(rows: list[dict], lengths: range = range(3, 9), ratio: float = 15.0, share: float = 0.1, enough: int = 3) -> tuple[str, ...]:
    """Beginnings of words that toxic documents of a language have and others lack.

    A stem is a candidate where ``ratio`` times as many of a language's toxic
    documents have it as of the others.  Candidates are taken greedily, the one
    that most of the documents not yet explained have, as long as these are
    ``share`` of the language's toxic documents (three at least); a document is
    explained by ``enough`` distinct words that begin with stems.  So words that
    merely stand in many copies of one document aren't taken once the document
    is explained.  A stem is lengthened as long as it keeps 95 % of its documents.
    """
    groups: dict[str, list[dict]] = {}
    for r in rows:
        groups.setdefault(r.get("lang") or "", []).append(r)
    found: set[str] = set()
    for group in groups.values():
        size = Counter(int(r["_y"]) for r in group)
        if size[1] < 4 or not size[0]:
            continue
        clean: Counter = Counter()
        toxic: list[dict[str, set[str]]] = []
        for r in group:
            ws = set(r["words"])
            if r["_y"]:
                heads: dict[str, set[str]] = {}
                for w in ws:
                    for n in lengths:
                        if n <= len(w):
                            heads.setdefault(w[:n], set()).add(w)
                toxic.append(heads)
            else:
                clean.update({w[:n] for w in ws for n in lengths if n <= len(w)})
        having: dict[str, list[int]] = {}
        for i, heads in enumerate(toxic):
            for p in heads:
                having.setdefault(p, []).append(i)
        least = max(3, share * size[1])
        telling = {
            p: docs for p, docs in having.items()
            if len(docs) >= least and len(docs) / size[1] >= ratio * (clean[p] + 0.5) / (size[0] + 1)
        }
        why: list[set[str]] = [set() for _ in toxic]
        while telling:
            gain = {p: sum(len(why[i]) < enough for i in docs) for p, docs in telling.items()}
            p = min(gain, key=lambda p: (-gain[p], len(p), p))
            if gain[p] < least:
                break
            while longer := sorted(q for q in having if len(q) == len(p) + 1 and q.startswith(p) and len(having[q]) >= 0.95 * len(having[p])):
                p = longer[0]
            found.add(p)
            for i in having[p]:
                why[i] |= toxic[i][p]
            telling = {q: d for q, d in telling.items() if not q.startswith(p) and not p.startswith(q)}
    return tuple(sorted(found))


def stems_for(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000) -> tuple[str, ...]:
    """Stems learnt from at most ``max_labelled`` labelled documents."""
    rows = labelled_sample(docs, labels, "toxic", {1: max_labelled // 2, 0: max_labelled // 2})

    def extract(batches):
        for batch in slices(batches, "text"):
            found = [sorted(set(re.findall(r"[^\W\d_]{3,}", (t or "").lower()))) for t in batch.column("text").to_pylist()]
            cols = [*[batch.column(c) for c in ("doc_id", "_y", "lang")], pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_y", "lang", "words"])

    # distinct words are taken where the texts are
    kind = rows.schema["doc_id"].dataType.simpleString()
    return learn_stems(by_id(rows.mapInArrow(extract, f"doc_id {kind}, _y int, lang string, words array<string>")))


def toxic_documents(
    docs: DataFrame, labels: DataFrame | None = None, threshold: float = 1.0, max_labelled: int = 3000
) -> DataFrame:
    """``doc_id, score, n_clauses`` of the documents whose score reaches ``threshold``.

    The lexicon is the built-in one and, with ``labels``, stems learnt from a
    bounded sample of labelled documents; labels of one class teach none.  Null and
    empty texts score 0 and are left out; whole texts are read, however long, a line
    at a time; a repeated row, and an id with several texts, is reported as often as
    it stands.  Other columns are ignored; an empty table gives an empty result.
    Map-only after the fit; the lexicon that travels is bounded by the sample.
    """
    stems = stems_for(docs, labels, max_labelled) if labels is not None else ()

    def run(batches):
        lexicon = words(stems)
        for batch in slices(batches, "text"):
            found = [score(t, lexicon) for t in batch.column("text").to_pylist()]
            hit = [i for i, f in enumerate(found) if f[0] >= threshold]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(hit, pa.int64())),
                    pa.array([found[i][0] for i in hit], pa.float64()),
                    pa.array([found[i][1] for i in hit], pa.int64()),
                ],
                ["doc_id", "score", "n_clauses"],
            )

    src = project(docs, doc_id="doc_id", text="text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, score double, n_clauses bigint")
