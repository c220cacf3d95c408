"""Twelve fictional parties, and builders for more."""

from partyloom.schema import party_ddl


def name(n, primary=False, native="", low=False, kind=None):
    return {"name": n, "type": kind or ("Primary" if primary else "A.K.A."), "primary": primary, "lowQuality": low, "script": "Latin", "native": native, "parts": []}


def party(id_, n, kind="Entity", lists=("SDN List",), authority="OFAC", aliases=(), native="", attributes=(), identifiers=(), relations=(), addresses=(), date="2023-05-01", measures=(), programs=("P1",)):
    return {
        "id": id_, "authority": authority, "list": lists[0], "lists": list(lists), "type": kind, "name": n, "title": "", "programs": list(programs),
        "sanctionsTypes": list(measures), "legalAuthorities": [], "datePublished": date, "remarks": "",
        "names": [name(n, True, native), *[name(a) if isinstance(a, str) else a for a in aliases]],
        "addresses": [{"full": f, "country": c} for f, c in addresses], "idDocuments": [],
        "relationships": [{"type": t, "relatedId": r, "relatedName": m, "inSnapshot": None} for t, r, m in relations],
        "attributes": [{"group": "Identity", "label": k, "value": v} for k, v in attributes],
        "identifiers": [{"type": k, "value": v} for k, v in identifiers],
    }


ROWS = [
    party("1", "Viktor Petrov Sokolin", "Individual", native="ВИКТОР СОКОЛИН", aliases=["Vik Sokolin"], attributes=[("Date of Birth", "12 Mar 1968"), ("Nationality", "Russian Federation")], identifiers=[("Passport", "AB 123456")], relations=[("Owner of (50%+)", "2", "")]),
    party("2", "Sokolin Shipping LLC", identifiers=[("LEI", "5299001TEST00A"), ("Tax ID No.", "770-1234567")], addresses=[("Pier 1, Moscow, Russia", "Russia")], relations=[("Owned 50%+ by", "1", ""), ("Linked to", "3", "")]),
    party("3", "MV Northern Gull", "Vessel", identifiers=[("IMO", "9345678"), ("MMSI", "273000111")], relations=[("Operated by", "2", "")], date="01/06/2023"),
    party("4", "Muhammad Ali Khan", "Individual", attributes=[("Date of Birth", "approx. 1985"), ("Citizenship", "Pakistan")]),
    party("5", "Caspian Marine Lines", lists=("Consolidated List", "Non-SDN CMIC List"), aliases=["CML JSC"], measures=["Block"]),
    party("6", "Redstone Holdings", lists=("Non-SDN CMIC List",), relations=[("Subsidiary of", "", "Redwall Group Co., Ltd.")], addresses=[("Road 5, Hong Kong", "Hong Kong")]),
    party("7", "Harbor Trade Company", relations=[("Owned or Controlled By", "2", "")], addresses=[("Located in Syria", "")]),
    party("8", "Delta Freight", lists=("Sectoral Sanctions",), relations=[("Acting for or on behalf of", "1", "")], date=""),
    party("EU-1", "Sokolin Viktor Petrov", "Individual", ("EU Consolidated List",), "EU", attributes=[("Date of Birth", "1968"), ("Gender", "M")], measures=["Asset freeze"]),
    party("EU-2", "SOKOLIN SHIPPING", "Entity", ("EU Consolidated List",), "EU", identifiers=[("Tax ID", "7701234567")], addresses=[("Moscow", "RUSSIAN FEDERATION")], measures=["Asset freeze"]),
    party("UK-1", "Viktor Petrov Sokolin", "Individual", ("UK Sanctions List",), "UK", attributes=[("Date of Birth", "1990")], measures=["Asset freeze"]),
    party("UN-1", "Orion Gulf Metals", "Entity", ("UN Consolidated List",), "UN", addresses=[("Dubai", "UAE")], identifiers=[("Registration", "Iran")]),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, party_ddl())
