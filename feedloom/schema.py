"""Table types of the document-feed store, and their additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


ARTICLE = _struct(
    id=StringType(),
    title=StringType(),
    link=StringType(),
    abstract=StringType(),
    author=StringType(),
    category=StringType(),
    comment=StringType(),
    status=IntegerType(),
    score=DoubleType(),
    hf_upvotes=IntegerType(),
    ax_net_votes=IntegerType(),
    votes_updated_at=TimestampType(),
    pushed_at=TimestampType(),
    recommend_date=DateType(),
    batch_order=IntegerType(),
    recommendation_type=StringType(),
    translated_title=StringType(),
    translated_abstract=StringType(),
    created_at=TimestampType(),
)

CHAT_PAPER = _struct(
    id=StringType(),
    arxiv_id=StringType(),
    title=StringType(),
    rating=IntegerType(),
    source_url=StringType(),
    github_url=StringType(),
    created_at=StringType(),
    updated_at=StringType(),
)

ABSTRACT = _struct(arxiv_id=StringType(), abstract=StringType(), updated_at=TimestampType())

TOOL_CALL = _struct(id=StringType(), type=StringType(), function=_struct(name=StringType(), arguments=StringType()))

MESSAGE = _struct(
    round_number=IntegerType(),
    role=StringType(),
    content=StringType(),
    token_count=LongType(),
    prompt_tokens=LongType(),
    completion_tokens=LongType(),
    cached_tokens=LongType(),
    skip_context=BooleanType(),
    created_at=StringType(),
    tool_calls=ArrayType(TOOL_CALL),
    tool_call_id=StringType(),
)

PAPER = _struct(
    session_id=StringType(),
    id=LongType(),
    title=StringType(),
    source_url=StringType(),
    arxiv_id=StringType(),
    content=StringType(),
    initial_summary=StringType(),
    references=StringType(),
    github_url=StringType(),
    model_used=StringType(),
    total_tokens_used=LongType(),
    total_prompt_tokens=LongType(),
    total_completion_tokens=LongType(),
    total_cached_tokens=LongType(),
    rating=IntegerType(),
    pinned=BooleanType(),
    created_at=StringType(),
    updated_at=StringType(),
    truncation_anchor=IntegerType(),
    messages=ArrayType(MESSAGE),
)

#: (version, column, type, older column whose value it takes where it is null), in order.
MIGRATIONS = [
    (2, "recommendation_type", "string", None),
    (3, "hf_upvotes", "int", None),
    (3, "ax_net_votes", "int", None),
    (4, "translated_title", "string", "title_cn"),
    (4, "translated_abstract", "string", "abstract_cn"),
    (5, "pushed_at", "timestamp", None),
    (6, "comment", "string", None),
]


def evolved(table: DataFrame, version: int = 0) -> DataFrame:
    """``table``, written at ``version``, with the columns of every later migration."""
    for step, name, kind, older in MIGRATIONS:
        if step > version:
            value = F.col(name) if name in table.columns else F.lit(None)
            if older in table.columns:
                value = F.coalesce(value, F.col(older))
            table = table.withColumn(name, value.cast(kind))
    return table


def conformed(table: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in its order; what the table lacks is null, what it has more goes."""
    have = set(table.columns)
    return table.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
