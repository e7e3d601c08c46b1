"""Questions of a session over evidence cards: search, context that later questions take over, profiles, bundles.

A session of every core asks for its most abundant taxon, then for functional capabilities without naming anything, then
for the site. All questions are answered at once, as tables keyed by session and question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions import columns as C
from varve.functions.columns import n_rows
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.plans.knowledge import _CARDS
from varve.plans.retrieval import _STOPS, WORD, evidence_cards, search, terms
from varve.sources.domain import Domain

TOP_K = 10
#: Order of card types in a bundle; unknown types come last.
PRIORITY = {"predicted_link": 0, "module": 1, "taxon": 2, "site": 3, "sample": 4}


def all_cards(d: Domain) -> DataFrame:
    """Sample, site and taxon cards, and one card per module."""
    members = d.prevalent.where("threshold = 5").select("taxon").join(d.taxa, "taxon").groupBy("functional_group").agg(n_rows().alias("n"))
    module = members.select(
        F.concat(F.lit("module:"), C.slugify(F.col("functional_group"))).alias("card_id"),
        F.lit("module").alias("card_type"),
        F.col("functional_group").alias("entity_id"),
        F.format_string("Module %s with %d taxa", "functional_group", "n").alias("title"),
        F.lit(None).cast("string").alias("core"),
    )
    return evidence_cards(d).unionByName(module)


def questions(d: Domain) -> DataFrame:
    """``(session, question_id, text)``."""
    amount = d.clr_primary.groupBy("core", "taxon").agg(F.sum("abundance").alias("s"))
    best = amount.groupBy(F.col("core").alias("session")).agg(F.min(F.struct((-F.col("s")).alias("m"), "taxon"))["taxon"].alias("taxon"))
    asked = F.array(F.concat(F.lit("Taxon "), "taxon", F.lit(" in samples")), F.lit("What are the top functional capabilities"), F.concat(F.lit("Site "), "session"))
    return best.select("session", F.posexplode(asked).alias("at", "text")).select("session", (F.col("at") + 1).alias("question_id"), "text")


def semantic_hits(cards: DataFrame, asked: DataFrame, ws: Workspace, k: int = TOP_K) -> DataFrame:
    """``(session, question_id, card_id, score, r)``: the k nearest cards of every question by the cards' term weights.

    Terms that no card holds take no part; a question without known terms has no hits.
    """
    t = ws.table(terms(cards.select("card_id", F.concat_ws(" ", "title", "core").alias("text")), "card_id", F.col("text")), "terms")
    n = cards.agg(n_rows().alias("n"))
    idf = t.groupBy("term").agg(n_rows().alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = ws.table(idf, "idf")

    def weights(tf: DataFrame, key: str) -> DataFrame:
        x = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
        return x.select(key, "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).alias("weight"))

    keyed = asked.select(F.concat_ws("|", "question_id", "session").alias("query_id"), "text")
    found = search(weights(t, "card_id"), weights(terms(keyed, "query_id", F.col("text")), "query_id"), "card_id", k)
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "card_id")))  # k rows a question
    parts = F.split("query_id", r"\|", 2)
    return found.select(parts[1].alias("session"), parts[0].cast("int").alias("question_id"), "card_id", "score", "r")


def context(hits: DataFrame, cards: DataFrame, asked: DataFrame) -> DataFrame:
    """``(session, question_id, own, taxa)``: taxa of a question's own hits by rank, and those it works with: its own, else the last ones before it."""
    taxa = hits.join(cards.where("card_type = 'taxon'").select("card_id", "entity_id"), "card_id")
    own = taxa.groupBy("session", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity_id"))), lambda s: s["entity_id"]).alias("own"))
    rows = asked.join(own, ["session", "question_id"], "left")
    # A session's questions are few.
    last = F.last("own", ignorenulls=True).over(Window.partitionBy("session").orderBy("question_id"))
    return rows.select("session", "question_id", "text", F.coalesce("own", F.array().cast("array<string>")).alias("own"), F.coalesce(last, F.array().cast("array<string>")).alias("taxa"))


class _Answers:
    """Cards, questions, hits and contexts of one folder, stored once."""

    def __init__(self, d: Domain):
        ws = Workspace(d.spark, "questions")
        self.cards, self.asked = ws.table(all_cards(d), "cards"), ws.table(questions(d), "asked")
        self.hits = ws.table(semantic_hits(self.cards, self.asked, ws), "hits")
        self.context = ws.table(context(self.hits, self.cards, self.asked), "context")


_VIEWS = f"""{_CARDS}, qcards AS (SELECT * FROM cards UNION ALL SELECT 'module:'||regexp_replace(regexp_replace(functional_group,'[^A-Za-z0-9]+','_','g'),'^_|_$','','g'), 'module', functional_group, 'Module '||functional_group||' with '||count(*)||' taxa', NULL
  FROM taxa WHERE taxon IN (SELECT taxon FROM prevalent WHERE threshold=5) GROUP BY functional_group),
asked AS (SELECT session, question_id, CASE question_id WHEN 1 THEN 'Taxon '||taxon||' in samples' WHEN 2 THEN 'What are the top functional capabilities' ELSE 'Site '||session END AS text
  FROM (SELECT core AS session, taxon FROM (SELECT core, taxon, sum(abundance) AS s FROM clr5 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY core ORDER BY s DESC, taxon)=1), (SELECT unnest([1,2,3]) AS question_id)),
toks AS (SELECT 'c' AS kind, card_id AS k, list_filter(regexp_extract_all(lower(concat_ws(' ',title,core)),'{WORD}'), lambda w: w NOT IN ({_STOPS})) AS w FROM qcards
  UNION ALL SELECT 'q', question_id||'|'||session, list_filter(regexp_extract_all(lower(text),'{WORD}'), lambda w: w NOT IN ({_STOPS})) FROM asked),
grams AS (SELECT kind, k, unnest(w) AS term FROM toks UNION ALL SELECT kind, k, unnest(list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])) FROM toks), tf AS (SELECT kind, k, term, count(*) AS tf FROM grams GROUP BY ALL),
idf AS (SELECT term, ln((1.0+(SELECT count(*) FROM qcards))/(1.0+count(*)))+1 AS idf FROM tf WHERE kind='c' GROUP BY term), raw AS (SELECT kind, k, term, tf*idf AS x FROM tf JOIN idf USING (term)),
vec AS (SELECT kind, k, term, x/sqrt(sum(x*x) OVER (PARTITION BY kind, k)) AS weight FROM raw),
scored AS (SELECT q.k AS q, c.k AS card_id, round(sum(c.weight*q.weight),6) AS score FROM vec c JOIN vec q ON c.term=q.term AND c.kind='c' AND q.kind='q' GROUP BY ALL),
hits AS (SELECT a.session, a.question_id, s.card_id, s.score, row_number() OVER (PARTITION BY q ORDER BY score DESC, s.card_id) AS r FROM scored s JOIN asked a ON s.q=a.question_id||'|'||a.session QUALIFY r<={TOP_K}),
own AS (SELECT session, question_id, list(entity_id ORDER BY r) AS own FROM hits JOIN qcards USING (card_id) WHERE card_type='taxon' GROUP BY ALL),
ctx AS (SELECT a.session, a.question_id, a.text, coalesce(own,[]) AS own, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY a.session ORDER BY a.question_id),[]) AS taxa FROM asked a LEFT JOIN own USING (session, question_id)),
focus AS (SELECT session, question_id, unnest(taxa) AS taxon FROM ctx)"""


@query("q09_general_answer", _VIEWS + " SELECT session, question_id, card_id, score, r FROM hits")
def general_answer(d: Domain):
    """The nearest cards of every question."""
    return _Answers(d).hits.select("session", "question_id", "card_id", "score", "r")


@query(
    "q10_context_carry",
    _VIEWS
    + """ SELECT session, question_id, CASE WHEN regexp_matches(lower(text),'functional capabilities|what are the top functional') THEN 'functional' ELSE 'general' END AS query_type, len(own)::INT AS n_own, array_to_string(taxa,';') AS taxa,
    len(own)=0 AND len(taxa)>0 AS carried FROM ctx""",
)
def context_carry(d: Domain):
    """The taxa that every question works with, and whether they come from an earlier one."""
    found = _Answers(d).context
    return found.select("session", "question_id", C.intent(F.col("text")).alias("query_type"), F.size("own").alias("n_own"), F.array_join("taxa", ";").alias("taxa"), ((F.size("own") == 0) & (F.size("taxa") > 0)).alias("carried"))


@query(
    "q08_functional_answer",
    _VIEWS
    + """, long AS (SELECT session, question_id, 'functional_group' AS capability, functional_group AS value FROM focus JOIN taxa USING (taxon) UNION ALL SELECT session, question_id, 'phylum', phylum FROM focus JOIN taxa USING (taxon)),
    n AS (SELECT session, question_id, capability, value, count(*) AS n FROM long GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY session, question_id, capability ORDER BY n DESC, value)<=10""",
)
def functional_answer(d: Domain):
    """How often each functional group and phylum stands among the taxa of a question; the ten most frequent of each."""
    answers = _Answers(d)
    focus = answers.context.select("session", "question_id", F.explode("taxa").alias("taxon")).join(d.taxa, "taxon")
    long = focus.select("session", "question_id", F.explode(F.create_map(F.lit("functional_group"), "functional_group", F.lit("phylum"), "phylum")).alias("capability", "value"))
    counts = long.groupBy("session", "question_id", "capability", "value").agg(n_rows().alias("n"))
    r = F.row_number().over(Window.partitionBy("session", "question_id", "capability").orderBy(F.desc("n"), "value"))
    return counts.withColumn("r", r).where("r <= 10").drop("r")


_BUNDLE = _VIEWS + """, parts AS (SELECT session, question_id, card_id, 0 AS source FROM hits UNION ALL SELECT session, question_id, c.card_id, 1 FROM focus JOIN qcards c ON c.card_type='taxon' AND c.entity_id=taxon
      UNION ALL SELECT DISTINCT session, question_id, c.card_id, 2 FROM focus JOIN taxa USING (taxon) JOIN qcards c ON c.card_type='module' AND c.entity_id=functional_group UNION ALL SELECT session, question_id, c.card_id, 3 FROM ctx JOIN qcards c ON c.card_type='site' AND c.entity_id=session),
    once AS (SELECT session, question_id, card_id, min(source) AS source FROM parts GROUP BY ALL),
    b AS (SELECT session, question_id, card_id, card_type, entity_id, title, source, CASE card_type WHEN 'module' THEN 1 WHEN 'taxon' THEN 2 WHEN 'site' THEN 3 WHEN 'sample' THEN 4 ELSE 9 END AS priority FROM once JOIN qcards USING (card_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY session, question_id ORDER BY priority, entity_id, card_id) AS position FROM b)"""


def _bundle(d: Domain, a: _Answers) -> DataFrame:
    """``(session, question_id, card_id, card_type, title, source, priority, position)`` of the cards every question rests on."""
    keys = ["session", "question_id"]
    focus = a.context.select(*keys, F.explode("taxa").alias("taxon"))
    of = lambda kind, entity: a.cards.where(F.col("card_type") == kind).select("card_id", F.col("entity_id").alias(entity))
    parts = [
        a.hits.select(*keys, "card_id"),
        focus.join(of("taxon", "taxon"), "taxon").select(*keys, "card_id"),
        focus.join(d.taxa, "taxon").join(of("module", "functional_group"), "functional_group").select(*keys, "card_id").distinct(),
        a.context.join(of("site", "session"), "session").select(*keys, "card_id"),
    ]
    rows = reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)])
    once = rows.groupBy(*keys, "card_id").agg(F.min("source").alias("source")).join(a.cards.select("card_id", "card_type", "entity_id", "title"), "card_id")
    priority = reduce(lambda c, p: c.when(F.col("card_type") == p[0], p[1]), PRIORITY.items(), F.when(F.lit(False), 9)).otherwise(9)
    once = once.withColumn("priority", priority)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "entity_id", "card_id"))
    return once.select(*keys, "card_id", "card_type", "title", "source", "priority", place.alias("position"))


@query("q11_retrieval_bundle", _BUNDLE + " SELECT session, question_id, card_id, card_type, source, priority, position FROM placed")
def retrieval_bundle(d: Domain):
    """All cards a question rests on: its hits, then cards of its taxa, of their modules and of its site, each once, by the first source.

    Cards are placed by the priority of their type, then by entity.
    """
    return _bundle(d, _Answers(d)).drop("title")


# What a prompt tells the reader of the evidence.
PROMPT_RULES = [
    "You are answering a scientific question using retrieval evidence.",
    "Use only the supplied evidence cards and graph context.",
    "Cite card_id values inline when making factual claims.",
    "If evidence is weak or missing, say so explicitly.",
    "Return JSON with keys: answer, evidence_ids, observations, predictions, uncertainty, followups.",
]
PROMPT_CARDS = 12
PROMPT_END = ["Response rule:", "Return a concise synthesis, list the strongest evidence IDs, and separate observations from predictions."]


@query(
    "q12_prompts",
    _BUNDLE
    + f""", lines AS (SELECT session, question_id, string_agg('- ['||card_id||'] '||title, chr(10) ORDER BY position) AS cards FROM placed WHERE position<={PROMPT_CARDS} GROUP BY ALL)
    SELECT session, question_id, '{"'||chr(10)||'".join(PROMPT_RULES)}'||chr(10)||chr(10)||'Question: '||text||chr(10)||'Query type: '||CASE WHEN regexp_matches(lower(text),'functional capabilities|what are the top functional') THEN 'functional' ELSE 'general' END
    ||chr(10)||chr(10)||'Top retrieved evidence cards:'||chr(10)||coalesce(cards,'- No evidence cards retrieved.')
    ||CASE WHEN len(taxa)>0 THEN chr(10)||'Functional capability tables available for the context taxa.'||chr(10)||'Taxon node context available for '||len(taxa)||' taxa.' ELSE '' END||chr(10)||chr(10)||'{"'||chr(10)||'".join(PROMPT_END)}' AS prompt
    FROM ctx LEFT JOIN lines USING (session, question_id)""",
)
def prompts(d: Domain):
    """The text that hands every question with its first 12 cards to a reader: rules, question, cards, context, how to answer."""
    a = _Answers(d)
    first = _bundle(d, a).where(F.col("position") <= PROMPT_CARDS).select("session", "question_id", F.struct("position", F.concat(F.lit("- ["), "card_id", F.lit("] "), "title").alias("line")).alias("l"))
    cards = first.groupBy("session", "question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda s: s["line"]), "\n").alias("cards"))
    n = F.size("taxa")
    context = F.when(n > 0, F.format_string("\nFunctional capability tables available for the context taxa.\nTaxon node context available for %d taxa.", n)).otherwise("")
    text = F.concat(
        F.lit("\n".join(PROMPT_RULES) + "\n\nQuestion: "), "text", F.lit("\nQuery type: "), C.intent(F.col("text")),
        F.lit("\n\nTop retrieved evidence cards:\n"), F.coalesce("cards", F.lit("- No evidence cards retrieved.")), context, F.lit("\n\n" + "\n".join(PROMPT_END)),
    )
    return a.context.join(cards, ["session", "question_id"], "left").select("session", "question_id", text.alias("prompt"))


@query(
    "q14_rendered_answers",
    _VIEWS
    + """ SELECT session, question_id, '## Query '||question_id||chr(10)||chr(10)||'**Question**: '||text||chr(10)||chr(10)||'- taxa: '||CASE WHEN len(taxa)=0 THEN 'none' ELSE array_to_string(taxa,', ') END||chr(10)||'- cards: '||
    coalesce((SELECT string_agg(card_id, ', ' ORDER BY r) FROM hits h WHERE h.session=ctx.session AND h.question_id=ctx.question_id),'none') AS markdown FROM ctx""",
)
def rendered_answers(d: Domain):
    """Every answer as a section of Markdown: the question, the taxa it works with and its nearest cards."""
    a = _Answers(d)
    cards = a.hits.groupBy("session", "question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "card_id"))), lambda s: s["card_id"]), ", ").alias("cards"))
    rows = a.context.join(cards, ["session", "question_id"], "left")
    taxa = F.when(F.size("taxa") == 0, "none").otherwise(F.array_join("taxa", ", "))
    text = F.concat(F.lit("## Query "), F.col("question_id").cast("string"), F.lit("\n\n**Question**: "), "text", F.lit("\n\n- taxa: "), taxa, F.lit("\n- cards: "), F.coalesce("cards", F.lit("none")))
    return rows.select("session", "question_id", text.alias("markdown"))
