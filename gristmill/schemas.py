"""Explicit schemas. Nothing in the library infers a schema from data.

Flat schemas are StructTypes; nested ones are DDL text, which every reader accepts.
"""

from pyspark.sql import types as T


def _flat(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

POSTING = _flat(title=_S, company=_S, url=_S, description=_S, location=_S, source=_S)
ORDERED_POSTING = _flat(title=_S, company=_S, url=_S, description=_S, location=_S, source=_S, source_rank=_I, ord=_L)

# One landed HTTP payload. `branch` tells search pages from browse pages where a board has both.
PAYLOAD = _flat(source=_S, slug=_S, branch=_S, page_no=_I, body=_S, ord=_L)
DETAIL = _flat(board=_S, slug=_S, job_id=_S, body=_S)
RSS_ITEM = _flat(title=_S, link=_S, guid=_S, description=_S, region=_S)
APP_LOG = _flat(title=_S, company=_S, score=_I, cover_letter=_S, fit_reason=_S, url=_S, status=_S)
LABELLED_TEXT = _flat(id=_S, title=_S, company=_S, role_family=_S, url=_S, description=_S, synthetic=T.BooleanType())

_BULLETS = "ARRAY<STRUCT<text: STRING, tags: ARRAY<STRING>>>"
CANDIDATE = (
    "candidate_id STRING, "
    "personal STRUCT<name: STRING, email: STRING, phone: STRING, location: STRING, "
    "github: STRING, linkedin: STRING, website: STRING>, "
    "summary STRING, "
    f"work_experience ARRAY<STRUCT<company: STRING, role: STRING, period: STRING, "
    f"bullets: {_BULLETS}, tags: ARRAY<STRING>, priority: STRING>>, "
    f"projects ARRAY<STRUCT<name: STRING, bullets: {_BULLETS}, tags: ARRAY<STRING>, "
    "link: STRING, priority: STRING>>, "
    "education ARRAY<STRUCT<degree: STRING, school: STRING, gpa: STRING, period: STRING, "
    "coursework: ARRAY<STRING>>>, "
    "skills ARRAY<STRUCT<category: STRING, skills: ARRAY<STRING>>>"
)
