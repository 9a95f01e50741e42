"""Model output of mixed types."""
import json

from pyspark.sql import functions as F

from quern.operators.record import parse

FULL = {
    "summary": " s ", "purpose": "null", "changeReason": "확인 필요", "before": "before", "after": 5, "relatedFeatures": ["로그인", " ", 3], "affectedRoles": ["프론트엔드", "개발자", "QA", "Frontend"],
    "needsConfirmation": ["check"], "riskScore": "150",
    "roleImpacts": [{"role": "FE", "impact": "i", "basis": "변경 기반 예상", "evidenceRefs": ["e1"]}, {"role": "qa", "impact": None, "basis": "guess", "evidenceIds": ["e2", " "]}, {"role": "painter"}, {"impact": "no role"}],
    "followUpTasks": ["write it", {"role": "BE", "task": " policy ", "evidence_refs": ["e1"]}, {"role": "개발자", "task": "open"}, {"role": "QA", "task": " "}, " "],
    "evidence": [{"id": "null", "source": "null", "location": "None", "description": "d"}], "reviews": [{"filePath": "", "lineNumber": 0, "comment": "c"}, {"filePath": "a.py", "lineNumber": "7", "comment": "d"}],
}


def test_a_full_record(spark):
    df = spark.createDataFrame([(1, json.dumps(FULL, ensure_ascii=False), ["백엔드", "프론트엔드"]), (2, json.dumps(FULL), [])], "id long, raw string, team array<string>")
    got = {r.id: r for r in parse(df, team="team").collect()}
    r = got[2]
    assert (r.parsed, r.errors, r.summary, r.purpose, r.changeReason, r.after, r.riskScore) == (True, [], "s", None, "확인 필요", "5", 100)
    assert r.relatedFeatures == ["로그인", "3"] and r.affectedRoles == ["프론트엔드", "QA"] and r.needsConfirmation == ["check"]
    assert [tuple(x) for x in r.roleImpacts] == [("프론트엔드", "i", "변경 기반 예상", ["e1"]), ("QA", "", None, ["e2"])]
    assert [tuple(x) for x in r.followUpTasks] == [(None, "write it", []), ("백엔드", "policy", ["e1"]), (None, "open", [])]
    assert [tuple(x) for x in r.evidence] == [(None, None, None, "d")]
    assert [tuple(x) for x in r.reviews] == [(None, None, "c"), ("a.py", 7, "d")]
    assert got[1].affectedRoles == ["프론트엔드"] and [x.role for x in got[1].roleImpacts] == ["프론트엔드"] and [x.role for x in got[1].followUpTasks] == [None, "백엔드", None]


def test_odd_records_name_their_paths(spark):
    raws = [None, "", "[1]", "{bad", '"x"', "{}", '{"summary": {"a": 1}, "followUpTasks": "do it", "extra": 1, "roleImpacts": ["x", {"role": "QA"}], "relatedFeatures": [["y"], "z"]}', '{"summary": null, "evidence": null}']
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    got = {r.id: r for r in parse(df).collect()}
    assert [got[i].parsed for i in range(8)] == [False] * 5 + [True] * 3
    assert all(got[i].errors == ["$: no JSON object"] and got[i].followUpTasks == [] and got[i].summary is None for i in range(5))
    assert got[5].errors == [] == got[7].errors
    assert sorted(got[6].errors) == ["$.extra: unknown field", "$.followUpTasks: STRING", "$.relatedFeatures[0]: ARRAY", "$.roleImpacts[0]: STRING", "$.summary: OBJECT"]
    assert got[6].relatedFeatures == ["z"] and [x.role for x in got[6].roleImpacts] == ["QA"] and got[6].followUpTasks == []


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("k", "{}", 1)], "key string, reply string, n long").withColumn("parsed", F.lit("old"))
    assert parse(df.drop("parsed"), "reply").select("key", "n", "parsed").first() == ("k", 1, True)
