"""Readers on small hand-written files, one for each published layout."""

import json

import pytest

from partyloom.sources import csl_json, eu_xml, lexicon, ofac_flat, ofac_xml, party_json, uk_csv, un_xml

OFAC = """<?xml version="1.0"?><sanctionsData><entities>
<entity id="101"><generalInfo><entityType>Individual</entityType></generalInfo>
<sanctionsLists><sanctionsList datePublished="2020-01-01">Consolidated List</sanctionsList><sanctionsList datePublished="2021-02-03">Non-SDN CMIC List</sanctionsList></sanctionsLists>
<sanctionsPrograms><sanctionsProgram>P-A</sanctionsProgram><sanctionsProgram>P-B</sanctionsProgram></sanctionsPrograms>
<sanctionsTypes><sanctionsType>Block</sanctionsType></sanctionsTypes>
<names><name><isPrimary>true</isPrimary><aliasType></aliasType><translations>
<translation><isPrimary>true</isPrimary><script>Latin</script><formattedFullName>SOKOLIN, Viktor</formattedFullName><nameParts><namePart><type>Last Name</type><value>SOKOLIN</value></namePart></nameParts></translation>
<translation><isPrimary>false</isPrimary><script>Cyrillic</script><formattedFullName>Соколин</formattedFullName></translation></translations></name>
<name><isPrimary>false</isPrimary><aliasType>F.K.A.</aliasType><isLowQuality>true</isLowQuality><translations><translation><isPrimary>true</isPrimary><script>Latin</script><formattedFirstName>Vik</formattedFirstName><formattedLastName>Sokol</formattedLastName></translation></translations></name></names>
<addresses><address><country>Russia</country><translations><translation><address1>Pier 1</address1><city>Moscow</city></translation></translations></address><address><country></country></address></addresses>
<features><feature><type>Birthdate</type><value>1975 to 1979</value><valueDate><isApproximate>false</isApproximate><isDateRange>true</isDateRange><fromDateBegin>1975-01-01</fromDateBegin><toDateEnd>1979-12-31</toDateEnd></valueDate></feature>
<feature><type>Nationality Country</type><value>Russia</value></feature><feature><type>Tax ID No.</type><value>7701</value></feature></features>
<identityDocuments><identityDocument><type>Passport</type><documentNumber>AB1</documentNumber><issuingCountry>Russia</issuingCountry></identityDocument></identityDocuments>
<relationships><relationship><type>Owner of (50%+)</type><relatedEntity entityId="102"/></relationship></relationships></entity>
<entity id="102"><names><name><isPrimary>true</isPrimary><translations><translation><isPrimary>true</isPrimary><formattedFullName>Gull &amp; Sons</formattedFullName></translation></translations></name></names></entity>
</entities></sanctionsData>"""


def test_ofac_xml(spark, tmp_path):
    (tmp_path / "o.xml").write_text(OFAC, encoding="utf-8")
    rows = {r["id"]: r for r in ofac_xml.read(spark, str(tmp_path / "o.xml")).collect()}
    a, b = rows["101"], rows["102"]
    assert (a["list"], a["lists"], a["datePublished"], a["type"]) == ("Non-SDN CMIC List", ["Consolidated List", "Non-SDN CMIC List"], "2021-02-03", "Individual")
    assert (a["name"], a["names"][0]["native"], a["names"][0]["parts"]) == ("SOKOLIN, Viktor", "Соколин", ["Last Name: SOKOLIN"])
    assert (a["names"][1]["name"], a["names"][1]["type"], a["names"][1]["lowQuality"]) == ("Vik Sokol", "F.K.A.", True)
    assert [(x["full"], x["country"]) for x in a["addresses"]] == [("Pier 1, Moscow, Russia", "Russia"), ("(address on file)", "")]
    assert [(x["label"], x["value"]) for x in a["attributes"]][0] == ("Birthdate", "1975 to 1979 (range 1975-01-01–1979-12-31)")
    assert [(x["type"], x["value"]) for x in a["identifiers"]] == [("Tax ID", "7701"), ("Passport", "AB1")]
    assert [(x["type"], x["relatedId"]) for x in a["relationships"]] == [("Owner of (50%+)", "102")]
    assert (b["name"], b["list"], b["type"], b["attributes"]) == ("Gull & Sons", "SDN List", "Individual", [])


def test_ofac_flat(spark, tmp_path):
    (tmp_path / "p.csv").write_text('36,"GULL ""SEA"" LINES","-0- ","A; B/C","-0-","-0-","Tanker","-0-","-0-","-0-","-0-","DOB 12 Mar 1968; Passport AB12 (Russia); Digital Currency Address - XBT 1abc; odd\nline; nationality Cuba"\nx,bad,-0-,-0-\n', encoding="utf-8")
    (tmp_path / "a.csv").write_text('36,2,"aka","SECOND NAME","weak"\n36,1,"fka","FIRST NAME","-0-"\n99,1,"aka","NOBODY","-0-"\n')
    (tmp_path / "d.csv").write_text('36,1,"Pier 1","Moscow 101","Russia","-0-"\n36,2,"-0-","-0-","-0-","-0-"\n')
    rows = ofac_flat.read(spark, *[str(tmp_path / f"{x}.csv") for x in "pad"], "SDN List").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["id"], r["name"], r["type"], r["programs"]) == ("36", 'GULL "SEA" LINES', "Individual", ["A", "B", "C"])
    assert [(n["name"], n["lowQuality"]) for n in r["names"]] == [('GULL "SEA" LINES', False), ("FIRST NAME", False), ("SECOND NAME", True)]
    assert [(a["full"], a["country"]) for a in r["addresses"]] == [("Pier 1, Moscow 101, Russia", "Russia")]
    assert [(a["label"], a["value"]) for a in r["attributes"]] == [("Date of Birth", "12 Mar 1968"), ("Passport", "AB12 (Russia)"), ("Digital Currency (XBT)", "1abc"), ("Remark", "odd\nline"), ("Nationality", "Cuba"), ("Vessel Type", "Tanker")]
    assert [(i["type"], i["value"]) for i in r["identifiers"]] == [("Passport", "AB12"), ("Crypto XBT", "1abc")]


def test_eu_xml(spark, tmp_path):
    (tmp_path / "e.xml").write_text(
        """<export><sanctionEntity logicalId="13" euReferenceNumber="EU.1" designationDate="2022-01-02"><subjectType code="person"/><remark>note</remark>
<nameAlias wholeName="Anna Bel" strong="true" function="Head"/><nameAlias wholeName="ANNA BEL" strong="false"/><nameAlias firstName="An" lastName="B" strong="false"/>
<regulation programme="RUS" numberTitle="1/2" publicationDate="2020-01-01"/><birthdate year="1970" circa="true" city="Minsk" countryDescription="BELARUS"/><citizenship countryDescription="UNKNOWN"/>
<address street="S 1" city="Minsk" countryDescription="BELARUS"/><identification number="P9" identificationTypeDescription="National passport" countryDescription="BELARUS"/><contactInfo value="a@b.c" typeDescription="E-mail"/></sanctionEntity></export>""",
        encoding="utf-8",
    )
    r = eu_xml.read(spark, str(tmp_path / "e.xml")).first()
    assert (r["id"], r["type"], r["name"], r["title"], r["datePublished"]) == ("EU-13", "Individual", "Anna Bel", "Head", "2022-01-02")
    assert [(n["name"], n["lowQuality"]) for n in r["names"]] == [("Anna Bel", False), ("An B", True)]
    assert [(a["label"], a["value"]) for a in r["attributes"]] == [("EU reference", "EU.1"), ("Date of Birth", "circa 1970"), ("Place of Birth", "Minsk, BELARUS"), ("E-mail", "a@b.c")]
    assert [(i["type"], i["value"]) for i in r["identifiers"]] == [("Passport", "P9"), ("Email", "a@b.c")]
    assert r["legalAuthorities"] == ["Council Regulation 1/2"] and r["addresses"][0]["full"] == "S 1, Minsk, BELARUS"


def test_un_xml(spark, tmp_path):
    (tmp_path / "u.xml").write_text(
        """<LIST><INDIVIDUALS><INDIVIDUAL><DATAID>7</DATAID><FIRST_NAME>A</FIRST_NAME><SECOND_NAME>B</SECOND_NAME><UN_LIST_TYPE>X</UN_LIST_TYPE><REFERENCE_NUMBER>R1</REFERENCE_NUMBER><LISTED_ON>2001-01-01</LISTED_ON>
<NATIONALITY><VALUE>Iraq</VALUE></NATIONALITY><INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>Ab</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_DATE_OF_BIRTH><FROM_YEAR>1950</FROM_YEAR><TO_YEAR>1952</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH>
<INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT><NUMBER>N1</NUMBER></INDIVIDUAL_DOCUMENT></INDIVIDUAL></INDIVIDUALS>
<ENTITIES><ENTITY><DATAID>8</DATAID><FIRST_NAME>Co</FIRST_NAME><ENTITY_ADDRESS><CITY>Paris</CITY><COUNTRY>France</COUNTRY></ENTITY_ADDRESS></ENTITY></ENTITIES></LIST>"""
    )
    rows = {r["id"]: r for r in un_xml.read(spark, str(tmp_path / "u.xml")).collect()}
    a = rows["UN-7"]
    assert a["name"] == "A B" and a["names"][1]["lowQuality"] and [(x["label"], x["value"]) for x in a["attributes"]] == [("UN reference", "R1"), ("Nationality", "Iraq"), ("Date of Birth", "1950–1952")]
    assert a["identifiers"][0]["type"] == "Passport" and rows["UN-8"]["type"] == "Entity" and rows["UN-8"]["addresses"][0]["full"] == "Paris, France"


def test_uk_csv(spark, tmp_path):
    head = "Group ID,Group Type,Name 1,Name 6,Alias Type,Alias Quality,Regime,Listed On,Address 1,Country,DOB,Passport Number"
    body = ['5,Individual,Ann,ALSO,AKA,Low,R1,01/02/2020,"Rd 1, x",UK,01/01/1970,P1', "5,Individual,Ann,MAIN,Primary name,,R1,03/02/2020,,,01/01/1970,P1", "6,Ship,Sea,,,,R2,,,,,"]
    (tmp_path / "k.csv").write_text("\n".join(["Last Updated,01/01/2024", head, *body]) + "\n")
    rows = {r["id"]: r for r in uk_csv.read(spark, str(tmp_path / "k.csv")).collect()}
    r = rows["UK-5"]
    assert (r["name"], r["datePublished"], r["type"], r["programs"]) == ("Ann MAIN", "03/02/2020", "Individual", ["R1"])
    assert [(n["name"], n["lowQuality"]) for n in r["names"]] == [("Ann MAIN", False), ("Ann ALSO", True)]
    assert [a["label"] for a in r["attributes"]] == ["Date of Birth", "Passport"] and [a["full"] for a in r["addresses"]] == ["Rd 1, x, UK"]
    assert [(i["type"], i["value"]) for i in r["identifiers"]] == [("Passport", "P1")] and rows["UK-6"]["type"] == "Vessel"


def test_csl_json(spark, tmp_path):
    el, dpl = (s for s, _, _ in csl_json.SOURCES[:2])
    data = {"results": [
        {"source": el, "id": "abcdefghijklmnop", "name": "Acme  Co", "alt_names": ["ACME CO", "Acme B"], "addresses": [{"city": "Oslo", "country": "NO"}], "ids": [{"type": "Passport No", "number": "1"}], "call_sign": "CS1", "standard_order": "Y"},
        {"source": dpl, "id": "2", "name": "Bob", "nationalities": ["US"]},
        {"source": "Other", "id": "3", "name": "Skip"},
    ]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    df = csl_json.read(spark, str(tmp_path / "c.json"))
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {"BIS-abcdefghijkl", "BIS-2"}
    a = rows["BIS-abcdefghijkl"]
    assert (a["name"], a["type"], a["list"], [n["name"] for n in a["names"]]) == ("Acme Co", "Vessel", "BIS Entity List", ["Acme Co", "Acme B"])
    assert [(i["type"], i["value"]) for i in a["identifiers"]] == [("Call Sign", "CS1"), ("Passport", "1")]
    assert rows["BIS-2"]["type"] == "Individual" and rows["BIS-2"]["sanctionsTypes"] == ["Denial of export privileges"]
    csl_json.assert_unique_ids(df)
    with pytest.raises(ValueError):
        csl_json.assert_unique_ids(df.unionByName(df.selectExpr("*").replace("Bob", "Rob", ["name"])))


def test_party_json_and_legacy_aliases(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"entities": [{"id": "1", "name": "A", "aliases": ["B"], "sanctionsType": "Block"}, {"id": "2", "name": "C", "lists": ["L"]}]}))
    rows = {r["id"]: r for r in party_json.read_document(spark, str(tmp_path / "s.json")).collect()}
    assert rows["1"]["names"][0]["name"] == "B" and rows["1"]["sanctionsTypes"] == ["Block"] and rows["2"]["remarks"] == "" and rows["2"]["lists"] == ["L"]


def test_lexicon(tmp_path):
    (tmp_path / "symbols.yml").write_text("org_symbols:\n  L.L.C.: [llc, 'l l c']\n  ООО:\n    - ooo\norg_domains:\n  bank:\n    - banka\n    - banco\n")
    (tmp_path / "org_types.yml").write_text("types:\n  - display: Limited\n    compare: ltd\n    aliases:\n      - limited company\n  - display: Inc\n")
    (tmp_path / "stopwords.yml").write_text("PERSON_NAME_PREFIXES:\n  - Mr\n  - Prof Dr\n  - Van\nORG_NAME_PREFIXES:\n- The\n")
    (tmp_path / "compare.yml").write_text("similar_pairs:\n  - ['0', 'O']\n")
    lex = lexicon.compile_lexicon(tmp_path)
    assert {"LLC", "OOO", "LIMITED", "LTD", "COMPANY", "INC", "THE"} <= lex.strip and not any(len(w) == 1 for w in lex.strip)
    assert lex.canon == {"BANKA": "BANK", "BANCO": "BANK"} and lex.titles[0] == ("PROF", "DR") and ("VAN",) not in lex.titles and lex.confusable == {"0O", "O0"}
