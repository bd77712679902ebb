"""Adapters against small sources written by hand."""

import json

from evidentia.sources import adapters
from evidentia.sources.parsers import crosswalk

XML = """<u:doc xmlns:u="http://xml.house.gov/schemas/uslm/1.0">
<u:section identifier="/us/usc/t8/s1184"><u:num>§ 1184.</u:num><u:heading> Admission  of nonimmigrants</u:heading>
<u:subsection><u:num>(a)</u:num><u:heading>Regulations</u:heading><u:paragraph><u:num>(1)</u:num><u:content>The admission of any alien shall be for such time
 as regulations prescribe.</u:content></u:paragraph></u:subsection><u:notes><u:note>Left out</u:note></u:notes></u:section>
<u:section identifier="/us/usc/t8/s1185" status="repealed"><u:content>{0}</u:content></u:section>
<u:section identifier="/us/usc/t8/s9999"><u:content>{0}</u:content></u:section>
<u:section identifier="/us/usc/t9/s1"><u:content>{0}</u:content></u:section>
<u:section identifier="/us/usc/t8/s1"><u:content>short</u:content></u:section></u:doc>""".format("word " * 30)


def test_statutes(spark, tmp_path):
    (tmp_path / "t8.xml").write_text(XML)
    assert crosswalk(spark).groupBy("code_section").count().filter("count > 1").isEmpty()
    a, b = adapters.read_statutes(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a.citation, a.title) == ("INA § 214 (8 U.S.C. § 1184)", "Admission of nonimmigrants")
    lines = a.text.split("\n")
    assert lines[0] == "Citation aliases: INA 214; INA section 214; 8 USC 1184; 8 U.S.C. 1184"
    assert lines[2:] == ["§ 1184.", "Admission of nonimmigrants", "(a) Regulations", "(1) The admission of any alien shall be for such time as regulations prescribe."]
    assert (b.citation, b.text.split("\n")[0], b.extra["ina_section"]) == ("8 U.S.C. § 9999", "Citation aliases: 8 USC 9999", None)


def test_notices(spark, tmp_path):
    long = "An abstract that is long enough to be evidence. " * 2
    rows = [
        {"document_number": "1", "abstract": long, "agencies": [{"name": "A"}, {"name": "B"}], "type": "Rule", "publication_date": "2024-01-02", "title": " T "},
        {"document_number": "1", "abstract": long + "later", "type": "Rule"},
        {"document_number": "2", "abstract": "short"},
        {"document_number": None, "abstract": long},
        {"document_number": "3", "abstract": long, "agencies": None, "effective_on": "2024-03-01", "citation": "89 FR 1", "publication_date": "2024-02-01"},
    ]
    (tmp_path / "n.json").write_text(json.dumps(rows))
    one, three = adapters.notices(adapters.read_notices(spark, str(tmp_path)), ["file", "place"]).orderBy("doc_id").collect()
    assert one.text == f"Document type: Rule\nAction: n/a\nAgency: A, B\nPublished: 2024-01-02\nEffective: not specified\n\n{long.strip()}"
    assert (one.title, one.citation, one.effective_date) == ("T", "Fed. Reg. Doc. 1", "2024-01-02")
    assert (three.citation, three.effective_date, three.url) == ("89 FR 1", "2024-03-01", "https://www.federalregister.gov/d/3")


def test_policy_pages(spark):
    base = "https://www.uscis.gov/policy-manual/volume-"
    urls = [f"{base}7-part-a-chapter-2/", f"{base}7-part-a-chapter-2", f"{base}2-part-b", f"{base}3", f"{base}12-part-c/es/x", "https://www.uscis.gov/forms"]
    pages = adapters.policy_pages(spark.createDataFrame([(u,) for u in urls], "url string")).orderBy("volume")
    assert [tuple(r)[1:] for r in pages.collect()] == [(2, "b", None), (7, "a", 2)]
    assert adapters.policy_pages(spark.createDataFrame([(u,) for u in urls], "url string"), volumes=[2]).count() == 1
