"""Row enrichment by language models (L1 to L25, S4, S5): scores, domains, rephrasing, labels.

Every operator takes a factory of a model, a function over a list of prompts
that gives a text for each (see :mod:`passagemill.operators.enrich`): the table
is reduced to its distinct prompts, these are sent in batches by Arrow workers,
and replies are read by JVM expressions.  Blank inputs are never sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.hashing import hash32, uniform01
from passagemill.functions.text import is_empty_text, sentences
from passagemill.operators.enrich import map_texts

# fixed values: the scored dimensions and how a summary names them
DIMENSIONS = ("relevance", "expertise_authority", "depth_specificity", "clarity_conciseness", "objectivity_bias", "completeness")
TITLES = ("Relevance", "Expertise/Authority", "Depth and Specificity", "Clarity and Conciseness", "Objectivity/Bias", "Completeness")
_SCORE = "struct<score:int,reasoning:string>"
EVALUATION = "struct<inferred_domain:string," + ",".join(f"{d}:{_SCORE}" for d in DIMENSIONS) + ">"
_TERM = "struct<term:string,type:string,confidence:double,reason:string>"
_TOPIC = "struct<topic_descriptor:string,probability:double,reason:string>"
#: Modes of the domain analysis: what they read besides the text, and the shape of a reply.
MODES = {
    "extract": f"struct<suggestions:array<{_TERM}>,total_suggestions:int>",
    "guess": f"struct<suggestions:array<{_TERM}>,total_suggestions:int,question_category:string>",
    "assess": f"struct<selected_terms:array<{_TERM}>,total_selected:int,question_intent:string>",
    "topic_relevance_prob": f"struct<topic_scores:array<{_TOPIC}>,total_topics:int>",
}
_LISTS = {"extract": ("suggestions", "total_suggestions"), "guess": ("suggestions", "total_suggestions"), "assess": ("selected_terms", "total_selected"), "topic_relevance_prob": ("topic_scores", "total_topics")}


def prompt(task: str, *fields: Column, include_reason: bool = False) -> Column:
    """The text a model is asked with: the task, its inputs, and whether reasons are wanted."""
    head = F.lit(f"task: {task}" + ("; give reasons" if include_reason else ""))
    return F.concat_ws("\n", head, *fields)


def parsed(reply: Column, shape: str) -> Column:
    """A reply read as JSON of the given shape, also inside a code fence or other talk; NULL if it holds none (L2)."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.from_json(body, shape))


def ask(df: DataFrame, asked: Column, make: Callable, out: str, error: str | None = None, retries: int = 2) -> DataFrame:
    """The rows with the reply to each one's prompt; rows whose prompt is NULL get none. Equal prompts are sent once."""
    keyed = df.withColumn("_prompt", asked)
    todo = keyed.where(F.col("_prompt").isNotNull()).select("_prompt").distinct()
    return keyed.join(map_texts(todo, "_prompt", make, out, retries=retries, error=error), "_prompt", "left").drop("_prompt")


def checked(make: Callable, ok: Callable[[str], bool], retries: int = 3) -> Callable:
    """A model whose replies are asked for again, up to ``retries`` times, until ``ok``; the last reply stands otherwise."""

    def factory():
        model = make()

        def run(texts):
            got = [x.strip() if x else x for x in model(texts)]
            for _ in range(retries):
                again = [i for i, x in enumerate(got) if not x or not ok(x)]
                if not again:
                    break
                for i, x in zip(again, model([texts[i] for i in again]), strict=True):
                    got[i] = x.strip() if x else x
            return got

        return run

    return factory


def sound(evaluation: Column) -> Column:
    """True if all six scores are there and lie in 0 to 10 (L4)."""
    ok = evaluation.isNotNull()
    for d in DIMENSIONS:
        ok = ok & F.coalesce(evaluation[d]["score"].between(0, 10), F.lit(False))
    return ok


def flattened(evaluation: Column, with_reasons: bool = False) -> list[Column]:
    """Columns of an evaluation: domain, a score for each dimension, reasons if wanted."""
    out = [evaluation["inferred_domain"].alias("inferred_domain")] + [evaluation[d]["score"].alias(f"{d}_score") for d in DIMENSIONS]
    return out + ([evaluation[d]["reasoning"].alias(f"{d}_reasoning") for d in DIMENSIONS] if with_reasons else [])


def score_summary(scores: list[Column]) -> Column:
    """Six lines ``- Name: n/10``."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {t}: "), F.coalesce(s.cast("string"), F.lit("None")), F.lit("/10")) for t, s in zip(TITLES, scores, strict=True)])


def evaluate(df: DataFrame, question: str, source: str, make: Callable, with_reasons: bool = False) -> DataFrame:
    """Domain and six scores of each pair, and ``evaluation_error`` where there are none (L1 to L4).

    Rows that have a score already keep what they have and are not sent; blank
    texts, failing models and replies out of shape are named in the error.
    """
    names = ["inferred_domain"] + [f"{d}_score" for d in DIMENSIONS] + ([f"{d}_reasoning" for d in DIMENSIONS] if with_reasons else [])
    kept = [n for n in names if n in df.columns]
    has = F.lit(False)
    for n in kept:
        if n.endswith("_score"):
            has = has | F.col(n).isNotNull()
    blank = is_empty_text(F.col(question)) | is_empty_text(F.col(source))
    asked = F.when(~has & ~blank, prompt("evaluate", F.col(question), F.col(source), include_reason=with_reasons))
    rows = ask(df.drop("evaluation_error"), asked, make, "_reply", "_failed").withColumn("_e", parsed(F.col("_reply"), EVALUATION))
    good = sound(F.col("_e"))
    wrong = F.when(has, F.lit(None).cast("string")).when(blank, "empty question or source").when(F.col("_failed").isNotNull(), F.col("_failed")).when(~good, "no valid evaluation")
    new = dict(zip(names, flattened(F.when(good, F.col("_e")), with_reasons), strict=True))
    return rows.select(*[F.col(c) for c in df.columns if c not in [*names, "evaluation_error"]], *[(F.coalesce(F.col(n), new[n]) if n in kept else new[n]).alias(n) for n in names], wrong.alias("evaluation_error"))


def corrected(reply: Column, mode: str) -> Column:
    """The reply with its stated count set to the number of items it lists."""
    items, total = _LISTS[mode]
    return reply.withField(items, F.coalesce(reply[items], F.array())).withField(total, F.size(F.coalesce(reply[items], F.array()))) if mode else reply


def analyze(df: DataFrame, mode: str, text: str, make: Callable, terms: str | None = None, prefix: str | None = None, include_reason: bool = False) -> DataFrame:
    """Domain analysis of a text column (L8 to L12): ``extract``, ``guess``, ``assess`` against ``terms``, ``topic_relevance_prob``.

    Adds ``<prefix>_items`` (the list as JSON), ``<prefix>_count`` and
    ``<prefix>_error``.  Rows whose count is there are skipped.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode in ("assess", "topic_relevance_prob") and not terms:
        raise ValueError(f"{mode} needs a column of terms")
    p = prefix or mode
    cols = [f"{p}_items", f"{p}_count", f"{p}_error"]
    done = F.col(cols[1]).isNotNull() if cols[1] in df.columns else F.lit(False)
    blank = is_empty_text(F.col(text))
    parts = [F.col(text)] + ([F.col(terms).cast("string")] if terms else [])
    rows = ask(df.drop(cols[2]), F.when(~done & ~blank, prompt(mode, *parts, include_reason=include_reason)), make, "_reply", "_failed")
    rows = rows.withColumn("_r", parsed(F.col("_reply"), MODES[mode]))
    good = corrected(F.col("_r"), mode)
    items, total = _LISTS[mode]
    fresh = [F.when(F.col("_r").isNotNull(), F.to_json(good[items])), F.when(F.col("_r").isNotNull(), good[total])]
    wrong = F.when(done, F.lit(None).cast("string")).when(blank, "empty text").when(F.col("_failed").isNotNull(), F.col("_failed")).when(F.col("_r").isNull(), "no readable reply")
    return rows.select(*[F.col(c) for c in df.columns if c not in cols], *[(F.coalesce(F.col(c), x) if c in df.columns else x).alias(c) for c, x in zip(cols, fresh, strict=False)], wrong.alias(cols[2]))


def topic_map(items: Column) -> Column:
    """``{descriptor: probability}`` of a list of topic scores, the last of equal descriptors."""
    x = F.from_json(items, f"array<{_TOPIC}>")
    return F.aggregate(x, F.create_map().cast("map<string,double>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != t["topic_descriptor"]), F.create_map(t["topic_descriptor"], t["probability"])))


def equivalent(reply: Column) -> Column:
    """True if a verifier calls two texts equivalent."""
    return F.coalesce(F.upper(reply).contains("EQUIVALENT"), F.lit(False))


def rephrase(df: DataFrame, text: str, make: Callable, out: str = "rephrased", verify: Callable | None = None, context: str | None = None, task: str = "rephrase") -> DataFrame:
    """A changed wording of each text (L15, L19, L20, L22); with ``verify`` only those a verifier calls equivalent.

    ``context`` names a column the wording has to fit (a source, a domain);
    where it is blank there is no result.
    """
    ok = ~is_empty_text(F.col(text))
    if context:
        ok = ok & ~is_empty_text(F.col(context))
    rows = ask(df, F.when(ok, prompt(task, F.col(text), *([F.col(context)] if context else []))), make, out)
    if verify is None:
        return rows
    rows = ask(rows, F.when(F.col(out).isNotNull(), prompt("same meaning?", F.col(text), F.col(out))), verify, "_verdict")
    return rows.withColumn(out, F.when(equivalent(F.col("_verdict")), F.col(out))).drop("_verdict")


def rephrase_sentence(df: DataFrame, rid: str, text: str, make: Callable, out: str = "rephrased", seed: int = 42) -> DataFrame:
    """One seeded sentence of each text in another wording, the others as they are."""
    s = df.withColumn("_s", sentences(F.col(text))).withColumn("_k", F.pmod(hash32(seed, "sentence", F.col(rid)), F.greatest(F.size("_s"), F.lit(1))).cast("int"))
    rows = ask(s, F.when(F.size("_s") > 0, prompt("rephrase", F.get("_s", F.col("_k")))), make, "_new")
    return rows.withColumn(out, F.when(F.col("_new").isNotNull(), F.array_join(F.transform("_s", lambda x, i: F.when(i == F.col("_k"), F.col("_new")).otherwise(x)), " "))).drop("_s", "_k", "_new")


def augment_modes(df: DataFrame, rid: str, text: str, make: Callable, mode: str = "random", share: float = 0.5, seed: int = 42) -> DataFrame:
    """Changed copies of a seeded share of the rows: whole texts, single sentences, or either by a seeded draw."""
    if mode not in ("full", "sentence", "random"):
        raise ValueError(f"unknown mode {mode}")
    drawn = df.where((uniform01(seed, "augment", F.col(rid)) < share) & ~is_empty_text(F.col(text)))
    whole = F.lit(mode == "full") if mode != "random" else uniform01(seed, "mode", F.col(rid)) < 0.5
    a = rephrase(drawn.where(whole), text, make, "_new")
    b = rephrase_sentence(drawn.where(~whole), rid, text, make, "_new", seed)
    return a.unionByName(b).where(F.col("_new").isNotNull()).withColumn(text, F.col("_new")).select(*df.columns)


def generate_questions(df: DataFrame, rid: str, text: str, make: Callable, n: int) -> DataFrame:
    """``n`` questions for each text from a reply ``{"questions": [...]}``, one row each with the other columns."""
    if n < 1:
        raise ValueError("n must be positive")
    rows = ask(df, F.when(~is_empty_text(F.col(text)), prompt(f"generate {n} questions", F.col(text))), make, "_reply")
    listed = F.filter(parsed(F.col("_reply"), "struct<questions:array<string>>")["questions"], lambda q: ~is_empty_text(q))
    return rows.select(*df.columns, F.posexplode(listed).alias("k", "question_text"))


def label_pairs(df: DataFrame, question: str, first: str, second: str, make: Callable, label: str = "label", overwrite: bool = False) -> DataFrame:
    """Which of two sources answers a question better: 1, 2, 0 for neither, -1 undecided.

    Labelled rows are skipped; with ``overwrite`` they are asked again, and a
    decided new label replaces the old one.
    """
    from passagemill.operators.enrich import merge_labels, verdict

    old = F.col(label) if label in df.columns else F.lit(None).cast("int")
    wanted = F.lit(True) if overwrite else (old.isNull() | (old == -1))
    filled = ~is_empty_text(F.col(question)) & ~is_empty_text(F.col(first)) & ~is_empty_text(F.col(second))
    rows = ask(df, F.when(wanted & filled, prompt("compare", F.col(question), F.col(first), F.col(second))), make, "_analysis")
    rows = ask(rows, F.when(F.col("_analysis").isNotNull(), prompt("verdict", F.col("_analysis"))), make, "_reply")
    new = F.when(F.col("_reply").isNotNull(), verdict(F.col("_reply")))
    return rows.select(*[c for c in df.columns if c != label], merge_labels(old, F.coalesce(new, old, F.lit(-1))).alias(label))
