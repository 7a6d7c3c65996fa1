"""Context for a question: policy chunks and data blocks of the schools it names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.functions.cleaning import canonical
from seatflow.functions.metrics import mask_not_open
from seatflow.operators.nesting import text_block
from seatflow.operators.ranking import keep_latest, top_rank
from seatflow.operators.vectors import OUT_OF_SCOPE, is_out_of_scope, top_k

TOP_K = 3
SEPARATOR = "\n\n---\n\n"

# Fixed values, here and in the block templates below: words that tell which data a question needs.
BALLOT_WORDS = (
    "ballot", "risk", "vacancy", "vacancies", "applied", "taken", "subscription",
    "oversubscribed", "phase", "competition", "competitive", "popular", "chance", "probability",
    "2a", "2b", "2c", "register", "registration", "distance", "priority", "compare",
    "comparison", "shortlist",
)
ATTRIBUTE_WORDS = (
    "type", "nature", "sap", "gifted", "gep", "autonomous", "special", "programme", "co-ed",
    "girls", "boys", "single session", "double session", "mother tongue", "chinese", "malay",
    "tamil", "zone", "estate", "north", "south", "east", "west", "area", "attributes",
    "what kind of school",
)
GENERAL_WORDS = (
    "contact", "phone", "telephone", "email", "website", "address", "location", "mrt", "bus",
    "transport", "how to get", "near", "principal", "teacher", "staff", "call", "reach",
)


def _mentions(text: Column, words: Sequence[str]) -> Column:
    listed = F.array(*[F.lit(w) for w in words])
    return F.exists(listed, lambda w: F.contains(F.lower(text), w))


def intent_flags(df: DataFrame, text: str) -> DataFrame:
    """Three flags per question; ballot data is the default when no word matches."""
    question = F.coalesce(F.col(text), F.lit(""))
    attributes, general = (
        _mentions(question, ATTRIBUTE_WORDS),
        _mentions(question, GENERAL_WORDS),
    )
    out = df.withColumns(
        {
            "_ballot": _mentions(question, BALLOT_WORDS),
            "needs_attributes": attributes,
            "needs_general": general,
        }
    )
    ballot = F.col("_ballot") | ~(F.col("needs_attributes") | F.col("needs_general"))
    return out.withColumn("needs_ballot", ballot).drop("_ballot")


def _shown(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("None"))


def ballot_blocks(mart: DataFrame, name: str = "school_name_clean") -> DataFrame:
    """Per school the rows of its latest year, the current one included, as text."""
    rows = top_rank(mart, [name], "registration_year")
    rows = rows.withColumn(
        "_tier", mask_not_open(F.col("vacancy"), F.col("ballot_risk_level"))
    )
    line = F.concat(
        F.lit("- Phase "), _shown("phase_normalised"),
        F.lit(": vacancy="), _shown("vacancy"),
        F.lit(", applied="), _shown("applied"),
        F.lit(", taken="), _shown("taken"),
        F.lit(", subscription_rate="), _shown("subscription_rate"),
        F.lit(", ballot_risk="), _shown("_tier"),
    )
    heading = F.concat(
        F.lit("\n## "), F.col("registration_year").cast("string"),
        F.lit(" Balloting Data: "), F.col(name),
    )
    return text_block(
        rows, [name, "registration_year"], "phase_normalised", line, heading, "ballot_text"
    )


def attribute_blocks(dim: DataFrame) -> DataFrame:
    """Per school its stable attributes as text."""

    def yes_no(col: str) -> Column:
        return F.when(F.col(col), "Yes").otherwise("No")

    tongues = F.concat_ws(
        ", ",
        F.coalesce("mothertongue1_code", F.lit("None")),
        F.nullif("mothertongue2_code", F.lit("")),
        F.nullif("mothertongue3_code", F.lit("")),
    )
    text = F.concat(
        F.lit("\n## School Attributes: "), F.col("school_name_clean"),
        F.lit("\n  Address: "), _shown("address"), F.lit(", Singapore "), _shown("postal_code"),
        F.lit("\n  Zone: "), _shown("zone_code"), F.lit(", Estate: "), _shown("dgp_code"),
        F.lit("\n  Type: "), _shown("type_code"), F.lit(", Nature: "), _shown("nature_code"),
        F.lit("\n  Session: "), _shown("session_code"),
        F.lit("\n  Special programmes: SAP="), yes_no("sap_ind"),
        F.lit(", GEP="), yes_no("gifted_ind"),
        F.lit(", Autonomous="), yes_no("autonomous_ind"),
        F.lit("\n  Mother tongue: "), tongues,
        F.lit("\n  Status: "), _shown("school_status_description"),
    )
    return dim.select("school_name_clean", text.alias("attribute_text"))


def contact_blocks(dim: DataFrame, general: DataFrame) -> DataFrame:
    """Per school its contact and transport details as text; unknown ones are left out."""
    labels = {
        "principal_name": "Principal",
        "telephone_no": "Phone",
        "email_address": "Email",
        "url_address": "Website",
        "mrt_desc": "MRT",
        "bus_desc": "Bus",
    }
    lines = [
        F.concat(F.lit(f"  {label}: "), F.nullif(col, F.lit(""))) for col, label in labels.items()
    ]
    heading = F.concat(F.lit("\n## Contact & Transport: "), F.col("school_name_clean"))
    return (
        dim.select("school_key", "school_name_clean")
        .join(general, "school_key", "left")
        .select("school_name_clean", F.concat_ws("\n", heading, *lines).alias("contact_text"))
    )


def policy_context(
    questions: DataFrame,
    chunks: DataFrame,
    question_id: str,
    k: int = TOP_K,
    domain: str | None = None,
) -> DataFrame:
    """Per question the ``k`` nearest chunks as one text, their sources and the best distance.

    ``domain`` limits the search to the chunks of one domain. ``chunks`` should be a stored
    table, as ``build_chunk_table`` leaves it: it is read once for the vectors and once for
    the texts of what was found.
    """
    if domain is not None:
        chunks = chunks.filter(F.col("domain") == domain)
    hits = top_k(chunks, questions, k, id_col="doc_id", query_id=question_id)
    detailed = hits.join(
        chunks.select(
            F.col("doc_id").alias("id"), "content", "topic", "source_file", "source_url"
        ),
        "id",
    )
    # At most k rows per question, so the collected lists are bounded.
    found = F.sort_array(
        F.collect_list(F.struct("rank", "content", "topic", "source_file", "source_url"))
    )
    source = ("topic", "source_file", "source_url")
    return (
        detailed.groupBy("query_id")
        .agg(found.alias("_found"), F.min("distance").alias("best_distance"))
        .select(
            "query_id",
            "best_distance",
            F.array_join(F.transform("_found", lambda r: r["content"]), SEPARATOR).alias(
                "policy_context"
            ),
            F.transform(
                "_found", lambda r: F.struct(*[r[c].alias(c) for c in source])
            ).alias("sources"),
        )
    )


def unique_sources(df: DataFrame, key: str = "query_id") -> DataFrame:
    """First source per file and question, in the order they were found."""
    rows = df.select(key, F.posexplode("sources").alias("place", "s")).select(key, "place", "s.*")
    return keep_latest(rows, [key, "source_file"], [F.col("place").asc()])


def _as_asked(text: Column, name: Column, asked: Column) -> Column:
    """A block whose heading shows the name the way the question spelled it."""
    at = F.position(name, text)
    rest = F.substring(text, at + F.length(name), F.length(text))
    return F.concat(F.substring(text, F.lit(1), at - 1), asked, rest)


def retrieve_context(
    questions: DataFrame,
    chunks: DataFrame,
    mart: DataFrame,
    dim: DataFrame,
    general: DataFrame,
    question_id: str = "question_id",
    question: str = "question",
    schools: str = "school_names",
    k: int = TOP_K,
    limit: float = OUT_OF_SCOPE,
    domain: str | None = None,
) -> DataFrame:
    """Everything an answer needs, one row per question.

    ``questions`` carries an ``embedding`` and an array of school names. A
    question without schools and without a near chunk is out of scope. The
    ballot block comes with every named school, the other two by intent.
    """
    policy = policy_context(questions, chunks, question_id, k, domain)
    named = F.size(F.coalesce(schools, F.array().cast("array<string>"))) > 0
    gated = (
        questions.select(F.col(question_id).alias("query_id"), named.alias("_named"))
        .join(policy, "query_id", "left")
        .withColumn("best_distance", F.coalesce("best_distance", F.lit(1.0)))
        .withColumn("out_of_scope", is_out_of_scope(F.col("best_distance"), F.col("_named"), limit))
        .drop("_named")
    )
    asked = (
        intent_flags(questions, question)
        .select(
            F.col(question_id).alias("query_id"),
            "needs_attributes",
            "needs_general",
            F.posexplode(schools).alias("place", "_name"),
        )
        .withColumn("school_name_clean", canonical(F.col("_name")))
    )
    blocks = (
        asked.join(ballot_blocks(mart), "school_name_clean", "left")
        .join(attribute_blocks(dim), "school_name_clean", "left")
        .join(contact_blocks(dim, general), "school_name_clean", "left")
    )

    def section(text: str, wanted: Column) -> Column:
        part = F.when(wanted, _as_asked(F.col(text), F.col("school_name_clean"), F.col("_name")))
        found = F.sort_array(
            F.collect_list(F.when(part.isNotNull(), F.struct("place", part.alias("t"))))
        )
        return F.nullif(
            F.array_join(F.transform(found, lambda r: r["t"]), "\n"), F.lit("")
        )

    context = blocks.groupBy("query_id").agg(
        F.nullif(
            F.concat_ws(
                "\n",
                section("ballot_text", F.lit(True)),
                section("attribute_text", F.col("needs_attributes")),
                section("contact_text", F.col("needs_general")),
            ),
            F.lit(""),
        ).alias("school_context")
    )
    out = gated.join(context, "query_id", "left")
    keep = ~F.col("out_of_scope")
    return out.select(
        "query_id",
        "best_distance",
        "out_of_scope",
        F.when(keep, F.col("policy_context")).alias("policy_context"),
        F.when(keep, F.col("sources")).alias("sources"),
        F.when(
            keep, F.coalesce("school_context", F.lit("No specific school data requested."))
        ).alias("school_context"),
        (keep & F.col("school_context").isNotNull()).alias("school_context_used"),
    )
