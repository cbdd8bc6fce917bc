"""The long form of the data set: odd tables against its SQL, and what its plan broadcasts and shuffles."""

import pytest
from compare import connection, same

from clauseloom.plans import ORACLE, QUERIES, answers  # noqa: F401

ATTEMPTS = [
    (1, "a", "q1", "no", "", "1", "high"),
    (1, "a", "q1", "no", "", "1", "high"),  # a copy
    (2, "a", "q1", "yes", " quote ", "2", "low"),
    (3, "a", "q1", "yes", "later", "3", "low"),
    (4, "a", "q2", None, None, " ", None),
    (5, "a", "unasked", "yes", "quote", "4", "high"),
    (6, "a", None, "yes", "quote", "4", "high"),
    (7, "b", "q2", "no", "", "5", "low"),
    (7, "b", "q2", "yes", "quote", "6", "high"),  # the same attempt, better
    (8, "gone", "q1", "yes", "quote", "7", "high"),
    (9, None, "q1", "yes", "quote", "8", "high"),
]
DOCUMENTS = [("a", "north"), ("a", "east"), ("b", None), ("unread", "south"), (None, "west")]
QUESTIONS = [("q1", "pay"), ("q2", None), ("q2", "leave"), (None, "other")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    fields = "attempt_id long, document_id string, question_id string, answer string, evidence string, page string, confidence string"
    for t, rows, schema in (("attempts", ATTEMPTS, fields), ("documents", DOCUMENTS, "document_id string, district string"), ("questions", QUESTIONS, "qid string, topic string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


def test_odd_tables_equal_sql(spark, odd):
    df = QUERIES["long_dataset"](spark, odd)
    same(df, connection(odd), ORACLE["long_dataset"])
    assert df.count() == 4 * len(QUESTIONS)  # four documents; a question that is listed twice comes twice, not four times


def test_broadcasts_the_codebook_alone_and_unfolds_it_last(spark, data):
    plan = QUERIES["long_dataset"](spark, data)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in plan]
    below = lambda k: "\n".join(x for j, x in enumerate(plan[k + 1 :], k + 1) if all(d > depth[k] for d in depth[k + 1 : j + 1]))
    sent = [below(k) for k, x in enumerate(plan) if "BroadcastExchange" in x]
    assert sent and all("questions.parquet" in x and "documents.parquet" not in x and "attempts.parquet" not in x for x in sent)
    unfolds = next(k for k, x in enumerate(plan) if "BroadcastNestedLoopJoin" in x or "Generate explode" in x)
    assert not [x for x in plan[:unfolds] if "Exchange" in x or "Sort" in x]
