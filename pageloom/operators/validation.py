"""Checks of evaluation questions against each other and against the corpus, as one message per problem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import clean_text, strip
from pageloom.operators.chunking import split_sentences
from pageloom.operators.retrieval import corpus_occurrences

# Categories, splits and failure tags of the question format, and the messages of its rules below.
ANSWERABLE = ("factoid", "numeric", "list", "yes_no", "paraphrase", "multi_section")
UNANSWERABLE = ("unanswerable_off_topic", "unanswerable_near_domain")
SPLITS = ("dev", "test")
TAGS = ("paraphrase", "exact_token", "distractor", "number_format", "cross_document", "cross_page", "late_in_page", "hyphenation", "requires_reasoning", "false_premise", "vague")
LONGEST_SENTENCE = 250


def duplicate_ids(questions: DataFrame) -> DataFrame:
    """(id, n): ids that stand more than once."""
    return questions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_questions(questions: DataFrame) -> DataFrame:
    """(question, n): question texts that stand more than once, blanks at the ends and letter case aside."""
    return questions.where("question is not null").groupBy(F.lower(strip(F.col("question"))).alias("question")).agg(F.count("*").alias("n")).where("n > 1")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(text, F.lit("None")), F.lit("'"))


def _listed(texts: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(texts, "', '"), F.lit("']"))


def _messages(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), text if isinstance(text, Column) else F.lit(text)) for test, text in pairs)))


def evidence_problems(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, passage_index, messages): problems of each evidence passage; each of the first four hides those after it.

    ``pages`` has file, page and text, one row for each page. The passage must stand on its page, only once
    in the whole corpus, and inside one sentence that is not too long.
    """
    cited = questions.select("id", F.posexplode("evidence").alias("passage_index", "e")).select("id", "passage_index", F.col("e.source").alias("file"), F.col("e.page").alias("page"), clean_text(F.col("e.text")).alias("passage"))
    clean = pages.select("file", "page", clean_text(F.col("text")).alias("page_text"))
    sentences = clean.select("file", "page", "page_text", split_sentences(F.col("page_text")).alias("sentences"))
    files = pages.groupBy("file").agg(F.max("page").alias("pages"))
    times = corpus_occurrences(cited, clean.select("page_text"))
    joined = cited.join(files, "file", "left").join(sentences, ["file", "page"], "left").join(times, "passage", "left")
    holding = F.filter("sentences", lambda s: F.contains(s, F.col("passage")))
    shortest = F.array_min(F.transform(holding, F.length))
    shown = _quoted(F.col("passage"))
    one = _messages(
        (F.col("occurrences") > 1, F.concat(F.lit("evidence occurs "), F.col("occurrences").cast("string"), F.lit(" times in the corpus, so retrieval hits would be ambiguous: "), shown)),
        (F.size(holding) == 0, F.concat(F.lit("evidence spans more than one sentence: "), shown)),
        (shortest > LONGEST_SENTENCE, F.concat(F.lit(f"evidence is in a sentence longer than {LONGEST_SENTENCE} characters: "), shown)),
    )
    messages = (
        F.when(F.col("pages").isNull(), F.array(F.concat(F.lit("evidence source "), _quoted(F.col("file")), F.lit(" is not in the corpus"))))
        .when(F.col("page_text").isNull(), F.array(F.concat("file", F.lit(" has no page "), F.coalesce(F.col("page").cast("string"), F.lit("None")))))
        .when(F.coalesce(F.col("passage"), F.lit("")) == "", F.array(F.lit("evidence text is empty")))
        .when(~F.contains("page_text", "passage"), F.array(F.concat(F.lit("evidence not found on "), "file", F.lit(" page "), F.col("page").cast("string"), F.lit(": "), shown)))
        .otherwise(one)
    )
    return joined.select("id", "passage_index", messages.alias("messages"))


def question_problems(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, ordinal, message): all problems of all questions, in order within a question.

    Questions are told apart by id; null arrays count as empty.
    """
    none = F.array().cast("array<string>")
    own = questions.withColumns({c: F.coalesce(F.col(c), none) for c in ("answers", "failure_tags", "list_items")})
    found = evidence_problems(questions, pages).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("passage_index", "messages"))).alias("_e"))
    own = own.join(found, "id", "left")
    unknown = F.array_sort(F.array_except("failure_tags", F.lit([*TAGS])))
    n_evidence = F.coalesce(F.size("evidence"), F.lit(0))
    n_evidence = F.when(n_evidence < 0, 0).otherwise(n_evidence)
    head = _messages(
        (strip(F.coalesce("question", F.lit(""))) == "", "question is empty"),
        (~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), F.concat(F.lit("unknown split "), _quoted(F.col("split")))),
        (F.size(unknown) > 0, F.concat(F.lit("unknown failure tags "), _listed(unknown))),
        (F.size(F.array_distinct("failure_tags")) < F.size("failure_tags"), "repeated failure tags"),
    )
    refusing = _messages(
        (~F.col("answerable").eqNullSafe(False), F.concat(F.lit("category "), "category", F.lit(" requires answerable=false"))),
        ((F.size("answers") > 0) | (n_evidence > 0) | (F.size("list_items") > 0), "unanswerable questions must have no answers, evidence or list_items"),
    )
    together = F.lower(F.array_join("_passages", " "))
    first = F.lower(F.col("_answers")[0])
    missing = F.filter("_items", lambda x: ~F.contains(together, F.lower(x)))
    reasoned = F.array_contains("failure_tags", "requires_reasoning")
    middle = _messages(
        (~F.col("answerable").eqNullSafe(True), F.concat(F.lit("category "), "category", F.lit(" requires answerable=true"))),
        ((F.size("answers") == 0) | F.exists("answers", lambda x: strip(x) == ""), "answerable questions need non-empty answers"),
        (n_evidence == 0, "answerable questions need evidence"),
    )
    evidence = F.coalesce(F.flatten(F.transform("_e", lambda x: x["messages"])), none)
    tail = _messages(
        ((F.col("category") == "yes_no") & ~((F.size("answers") == 1) & F.get("answers", F.lit(0)).isin("yes", "no")), 'yes_no answers must be ["yes"] or ["no"]'),
        ((F.col("category") != "yes_no") & (F.size("answers") > 0) & ~reasoned & ~F.contains(together, first), F.concat(F.lit("first answer "), _quoted(F.get("answers", F.lit(0))), F.lit(" does not appear in the evidence"))),
        ((F.col("category") == "list") & (F.size("list_items") < 2), "list questions need at least two list_items"),
        ((F.col("category") == "list") & (F.size(missing) > 0), F.concat(F.lit("list_items not in the evidence: "), _listed(missing))),
        ((F.col("category") != "list") & (F.size("list_items") > 0), "only list questions may have list_items"),
        ((F.col("category") == "multi_section") & (n_evidence < 2), "multi_section questions need at least two evidence passages"),
    )
    passages = _cleaned_arrays(questions)
    own = own.join(passages, "id", "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("_passages", "_answers", "_items")})
    own = own.withColumns({"_answers": F.when(F.size("_answers") > 0, F.col("_answers")).otherwise(F.array(F.lit("")))})
    body = (
        F.when(F.col("category").isin(*UNANSWERABLE), F.concat(head, refusing))
        .when(~F.coalesce(F.col("category").isin(*ANSWERABLE), F.lit(False)), F.concat(head, F.array(F.concat(F.lit("unknown category "), _quoted(F.col("category"))))))
        .otherwise(F.concat(head, middle, evidence, tail))
    )
    return own.select("id", F.posexplode(body).alias("ordinal", "message"))


def _cleaned_arrays(questions: DataFrame) -> DataFrame:
    """(id, _passages, _answers, _items): the texts of a question in clean form, in order."""
    parts = []
    for name, source in (("_passages", F.col("evidence.text")), ("_answers", F.col("answers")), ("_items", F.col("list_items"))):
        parts.append(questions.select("id", F.lit(name).alias("what"), F.posexplode(source).alias("place", "text")))
    texts = reduce(DataFrame.unionByName, parts).select("id", "what", "place", clean_text(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    gathered = texts.groupBy("id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == name, F.struct("place", "text")))), lambda x: x["text"]).alias(name) for name in ("_passages", "_answers", "_items")))
    return gathered


def dataset_problems(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(part, id, ordinal, message): duplicate ids, then duplicate question texts, then the problems of each question."""
    ids = duplicate_ids(questions).select(F.lit(0).alias("part"), "id", F.lit(0).alias("ordinal"), F.concat("id", F.lit(": duplicate id")).alias("message"))
    texts = duplicate_questions(questions).select(F.lit(1).alias("part"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("ordinal"), F.concat(F.lit("duplicate question "), _quoted(F.col("question"))).alias("message"))
    each = question_problems(questions, pages).select(F.lit(2).alias("part"), "id", "ordinal", F.concat("id", F.lit(": "), "message").alias("message"))
    return ids.unionByName(texts).unionByName(each)


def dataset_counts(questions: DataFrame) -> dict[str, DataFrame]:
    """The counts of the dataset report: totals, by split, by category and split, and by failure tag."""
    return {
        "totals": questions.agg(F.count("*").alias("questions"), F.count_if(F.col("answerable")).alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable")),
        "by_split": questions.groupBy("split").agg(F.count("*").alias("n")),
        "by_category": questions.groupBy("category", "split").agg(F.count("*").alias("n")),
        "by_tag": questions.select(F.explode("failure_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")),
    }


def select_questions(questions: DataFrame, split: str = "all", ids: list[str] | None = None) -> DataFrame:
    """Questions of a split, or with the given ids; ValueError for an unknown split or id and for an empty selection."""
    if split not in (*SPLITS, "all"):
        raise ValueError(f"Unknown split {split!r}; choose from {[*SPLITS, 'all']}")
    chosen = questions if split == "all" else questions.where(F.col("split") == split)
    if ids:
        wanted = questions.sparkSession.createDataFrame([(x,) for x in sorted(set(ids))], "id string")
        unknown = [r.id for r in wanted.join(questions, "id", "left_anti").orderBy("id").collect()]
        if unknown:
            raise ValueError(f"Unknown question ids {unknown}")
        chosen = chosen.join(F.broadcast(wanted), "id", "left_semi")
    if chosen.isEmpty():
        raise ValueError("No questions match the selection")
    return chosen
