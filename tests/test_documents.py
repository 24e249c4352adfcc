"""Documents end to end: decode, search, tables, archive, sinks."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import tarfile

import pytest

from kelvinlake.errors import AmbiguousComponent, ComponentNotFound, DownloadError, ParseError, ReferenceIntegrityError, SourceError, ValidationError
from kelvinlake.operators import identity, summary
from kelvinlake.operators.search import datasets, search
from kelvinlake.plans import archive as plans
from kelvinlake.plans import tables
from kelvinlake.sinks.files import write_file
from kelvinlake.sources import decode, remote, scan

NS = decode.NAMESPACE


def compound(n, name, formula, key=None):
    strong = f"<sStandardInChI>InChI=1S/{formula}/{n}</sStandardInChI><sStandardInChIKey>{key}</sStandardInChIKey>" if key else ""
    return f"<Compound><RegNum><nOrgNum>{n}</nOrgNum></RegNum>{strong}<sCommonName>{name}</sCommonName><sFormulaMolec>{formula}</sFormulaMolec></Compound>"


def dataset(n, members, group, prop, rows, variable, constraint="", phases=()):
    parts = "".join(f"<Component><RegNum><nOrgNum>{m}</nOrgNum></RegNum></Component>" for m in members)
    parts += f"<Property><nPropNumber>1</nPropNumber><Property-MethodID><PropertyGroup><{group}><ePropName>{prop}</ePropName><eMethodName>static</eMethodName></{group}></PropertyGroup></Property-MethodID><PropPhaseID><ePropPhase>Liquid</ePropPhase></PropPhaseID><CombinedUncertainty><nCombUncertAssessNum>1</nCombUncertAssessNum><sCombUncertEvaluator>lab</sCombUncertEvaluator><nCombCoverageFactor>2</nCombCoverageFactor></CombinedUncertainty></Property>"
    parts += "".join(f"<PhaseID><ePhase>{p}</ePhase></PhaseID>" for p in phases) + constraint
    parts += f"<Variable><nVarNumber>1</nVarNumber><VariableID><VariableType><eT>{variable}</eT></VariableType></VariableID></Variable>"
    for x, y in rows:
        parts += f"<NumValues><VariableValue><nVarNumber>1</nVarNumber><nVarValue>{x}</nVarValue></VariableValue><PropertyValue><nPropNumber>1</nPropNumber><nPropValue>{y}</nPropValue><nPropDigits>2</nPropDigits><CombinedUncertainty><nCombUncertAssessNum>1</nCombUncertAssessNum><nCombStdUncertValue>0.005</nCombStdUncertValue></CombinedUncertainty></PropertyValue></NumValues>"
    return f"<PureOrMixtureData><nPureOrMixtureDataNumber>{n}</nPureOrMixtureDataNumber>{parts}</PureOrMixtureData>"


CONSTRAINT = "<Constraint><nConstraintNumber>1</nConstraintNumber><ConstraintID><ConstraintType><eT>Temperature, K</eT></ConstraintType></ConstraintID><nConstraintValue>298.15</nConstraintValue></Constraint>"
XML = (
    f'<?xml version="1.0"?><DataReport xmlns="{NS}"><Version><nVersionMajor>2</nVersionMajor><nVersionMinor>0</nVersionMinor></Version>'
    "<Citation><sAuthor>Doe, J.[Jane]</sAuthor><sAuthor>Roe, R.</sAuthor><sTitle>On gases</sTitle><yrPubYr>2020</yrPubYr><sDOI>https://doi.org/10.1/ABC</sDOI><sPubName>J. Tests</sPubName></Citation>"
    + compound(1, "carbon dioxide", "CO2", "KEYA") + compound(2, "water", "H2O", "KEYB") + compound(3, "methanol", "CH4O")
    + dataset(1, (1, 2), "CompositionAtPhaseEquilibrium", "Mole fraction", ((1000, "0.10"), (2000, "0.20"), (3000, "0.30")), "Pressure, kPa", CONSTRAINT, ("Gas", "Liquid"))
    + dataset(2, (2,), "VolumetricProp", "Mass density, kg/m3", (("298.15", "997.0"), ("308.15", "994.0")), "Temperature, K")
    + dataset(3, (1, 2, 3), "RefractionSurfaceTensionSoundSpeed", "Interfacial tension, N/m", (("310.0", "0.050"),), "Temperature, K")
    + "</DataReport>"
).encode()


def twin(node):
    if not node.children:
        return node.text
    out, order = {}, list(dict.fromkeys(c.tag for c in node.children))
    for tag in order:
        found = [twin(c) for c in node.all(tag)]
        out[tag] = found if len(found) > 1 else found[0]
    return out | {decode.ORDER_KEY: order}


def as_json(xml_tree_of: bytes, md5_of: bytes) -> bytes:
    return json.dumps(twin(decode.xml_tree(xml_tree_of)) | {decode.MD5_KEY: hashlib.md5(md5_of).hexdigest()}).encode()


@pytest.fixture(scope="module")
def sets(spark):
    return datasets(scan.documents(scan.decode_documents(scan.read_source(spark, XML))))


@pytest.fixture(scope="module")
def index(spark):
    return identity.build_index(identity.compounds(scan.documents(scan.decode_documents(scan.read_source(spark, XML)))))


def numbers(df):
    return [r.number for r in df.select("ds.number").collect()]


def test_decode_keeps_text_and_inherits():
    doc = decode.from_xml(XML)
    value = doc["datasets"][0]["points"][0]["property_values"][0]
    assert value["value"] == "0.10" and value["value_double"] == 0.1
    u = value["uncertainties"][0]
    assert (u["standard_value"], u["coverage_factor"], u["evaluator"]) == ("0.005", "2", "lab")
    assert [len(d["points"]) for d in doc["datasets"]] == [3, 2, 1]
    again = decode.from_json(as_json(XML, XML))
    assert again["datasets"] == doc["datasets"] and again["warnings"]


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda x: x[:-20], ParseError),
        (lambda x: x.replace(b"DataReport", b"Other"), ParseError),
        (lambda x: x.replace(NS.encode(), b"urn:x"), ParseError),
        (lambda x: x.replace(b"<DataReport", b'<!DOCTYPE d [<!ENTITY e "x">]><DataReport', 1), ParseError),
        (lambda x: x.replace(b"<nVersionMajor>2", b"<nVersionMajor>two"), ParseError),
        (lambda x: x.replace(b"<nPropValue>0.10", b"<nPropValue>abc"), ParseError),
        (lambda x: x.replace(b"<RegNum><nOrgNum>3</nOrgNum></RegNum></Component>", b"<RegNum><nOrgNum>9</nOrgNum></RegNum></Component>"), ReferenceIntegrityError),
        (lambda x: x.replace(b"<RegNum><nOrgNum>3</nOrgNum></RegNum><sCommon", b"<RegNum><nOrgNum>2</nOrgNum></RegNum><sCommon"), ValidationError),
    ],
)
def test_decode_errors(change, error):
    with pytest.raises(error):
        decode.from_xml(change(XML))


@pytest.mark.parametrize("text", [b"[]", b"{", b'{"tml_elements": 3}', b'{"THERMOML_MD5_CHECKSUM": "x"}', b'{"a": NaN}'])
def test_json_errors(text):
    with pytest.raises(ParseError):
        decode.from_json(text)


def test_search(sets, index):
    assert numbers(search(sets, index, components="water")) == [1, 2, 3]
    assert numbers(search(sets, index, components="water", component_match="exact")) == [2]
    pool = ["water", "carbon dioxide"]
    assert numbers(search(sets, index, components=pool, component_match="within", required_components=["water"])) == [1, 2]
    three = [*pool, "methanol"]
    assert numbers(search(sets, index, components=three, component_match="within", required_components=pool)) == [1, 3]
    assert numbers(search(sets, index, system=["H2O", "CO2"], data_type="VLE")) == [1]
    assert numbers(search(sets, index, independent_variable="pressure")) == [1]
    assert numbers(search(sets, index, property_name="DENSITY")) == [2]
    assert numbers(search(sets, index, limit=1)) == [1]
    assert numbers(search(sets, index, system=pool, independent_variable="temperature")) == []
    with pytest.raises(ValueError):
        search(sets, index, components="water", system=["water"])
    with pytest.raises(ValueError):
        search(sets, index, components="water", required_components=["water"])


def test_identity(spark, index):
    assert identity.resolve(index, "h2o").stable_identifier == "inchikey:KEYB"
    assert identity.resolve(index, "formula:CO2").preferred_name == "carbon dioxide"
    with pytest.raises(ComponentNotFound):
        identity.resolve(index, "argon")
    assert identity.explicit_identity("64-17-5").stable_identifier == "cas:64-17-5"
    assert identity.explicit_identity("ethanol") is None
    base = {"cas_name": None, "iupac_name": None, "standard_inchi": None, "standard_inchi_key": None, "cas_registry_number": None, "samples": []}
    rows = [
        (0, 0, base | {"local_id": 1, "common_names": ["Alpha"], "formula": "X", "cas_registry_number": "50-00-0"}),
        (0, 1, base | {"local_id": 2, "common_names": ["beta"], "formula": "X", "standard_inchi_key": "K1", "cas_registry_number": "50-00-0"}),
        (1, 0, base | {"local_id": 1, "common_names": ["gamma"], "formula": "X", "standard_inchi_key": "K2"}),
        (1, 1, base | {"local_id": 2, "common_names": ["alpha"], "formula": None}),
        (1, 2, base | {"local_id": 3, "common_names": [], "formula": "X"}),
    ]
    from kelvinlake.sources.schema import COMPOUND

    df = spark.createDataFrame(rows, f"doc long, pos int, c {COMPOUND}")
    found = identity.build_index(df)
    assert {r.stable_id for r in found.collect()} == {"inchikey:K1", "inchikey:K2", "name:x"}
    assert identity.resolve(found, "ALPHA").aliases["common"] == ("Alpha", "beta")
    with pytest.raises(AmbiguousComponent):
        identity.resolve(found, "X")
    assert identity.aliases(found).where("kind = 'auto' and alias = 'x'").count() == 3


def test_summary(spark, sets):
    docs = scan.documents(scan.decode_documents(scan.read_source(spark, XML)))
    assert tuple(summary.totals(docs, sets).first()) == (1, 3, 6, 6, 0)
    ranked = summary.rankings(sets)
    assert [tuple(r)[1:] for r in summary.top(ranked, "components", 2).collect()] == [("water", 6), ("carbon dioxide", 4)]
    assert summary.top(ranked, "systems").count() == 3
    with pytest.raises(ValueError):
        summary.top(ranked, "nothing")
    entries = summary.catalog(sets)
    row = entries.where("category = 'volumetric'").first()
    assert (row.property, row.variable, row.relations, row.datasets, row.publications) == ("Mass density, kg/m3", "Temperature, K", 2, 1, 1)
    assert summary.catalog_variables(entries, "VLE", "mole fraction").first().variable == "Pressure, kPa"


def test_tables(sets, index, tmp_path):
    long = tables.experimental_table(search(sets, index))
    assert len(long.columns) == 54
    rows = long.collect()
    assert len(rows) == 6 and rows[0].value == "0.10" and rows[0].citation_authors_year == "Doe & Roe (2020)"
    assert rows[0].citation_bibtex.startswith("@article{doe2020_")
    matches = search(sets, index, system=["CO2", "H2O"], independent_variable="pressure")
    rel = tables.relation_table(matches)
    assert len(rel.columns) == 67 and [r.independent_variable_value for r in rel.collect()] == ["1000", "2000", "3000"]
    assert json.loads(rel.first().complementary_conditions_json)[0]["value"] == "298.15"
    wide = tables.analysis_table(tables.relations(matches))
    assert wide.columns == ["Temperature, K", "Pressure, kPa", "Mole fraction", *tables.ANALYSIS_TAIL]
    assert wide.first()["Temperature, K"] == "298.15"
    small = long.select("doi", "dataset_number", "value")
    for name in ("t.csv", "t.json", "t.yaml", "t.parquet"):
        write_file(small, tmp_path / name)
    with open(tmp_path / "t.csv", newline="") as f:
        assert len(list(csv.DictReader(f))) == 6
    assert len(json.loads((tmp_path / "t.json").read_text())["rows"]) == 6
    import pyarrow.parquet as pq
    import yaml

    assert len(yaml.safe_load((tmp_path / "t.yaml").read_text())["rows"]) == 6
    assert pq.read_table(tmp_path / "t.parquet").num_rows == 6
    with pytest.raises(ValueError):
        write_file(small, tmp_path / "t.xls")
    assert tables.concatenate(small, small).count() == 12
    with pytest.raises(ValueError):
        tables.concatenate(small, long)


def tar(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def test_archive(spark, tmp_path):
    other = XML.replace(b"KEYA", b"KEYC").replace(b"CO2/1", b"CO2/9").replace(b"10.1/ABC", b"10.1/DEF")
    broken = XML.replace(b"</DataReport>", b"<x>")
    path = tar(tmp_path / "a.tgz", {"d/a.xml": XML, "d/b.XML": other, "c.xml": broken, "c.json": as_json(XML, broken), "bad.xml": b"<DataReport>\xff", "n.txt": b"x"})
    a = plans.open_archive(spark, path)
    assert a.counters() == {"scanned": 4, "parsed": 3, "failed": 1, "recovered": 1}
    assert a.recoveries.first().failed_locator == "c.xml"
    with pytest.raises(AmbiguousComponent):
        identity.resolve(a.index(), "CO2")
    result = plans.query(a, components="water", independent_variable="temperature", publication_limit=1)
    assert (result.available_publications, result.matched_datasets) == (2, 6)
    assert [r.relations for r in result.publications.collect()] == [6]
    assert result.table.count() == 6 and "Mass density, kg/m3" in result.analysis.columns
    found = plans.analyze(a, "inchikey:KEYC", index=a.index())
    assert found.matched_documents == 1 and found.totals.first().observations == 4
    assert plans.catalog(a).where("category = 'VLE'").first().relations == 9
    with pytest.raises(Exception, match="bad.xml"):
        plans.open_archive(spark, path, on_error="raise")
    assert plans.open_archive(spark, path, prefilter=["KEYC"]).counters()["scanned"] == 1
    wrong = tar(tmp_path / "w.tar", {"c.xml": broken, "c.json": as_json(XML, XML)})
    assert plans.open_archive(spark, wrong).counters()["failed"] == 1


class Reader(io.BytesIO):
    pass


def test_remote(spark, tmp_path):
    pages = {"https://x.test/a.xml": XML[:-5], "https://x.test/a.json": as_json(XML, XML[:-5])}
    get = lambda url, timeout: (200, {}, Reader(pages[url]))
    assert remote.load_url(spark, "https://x.test/a.xml", get=get).first().recovery is not None
    with pytest.raises(DownloadError):
        remote.download("http://x.test/a", get=get)
    with pytest.raises(DownloadError):
        remote.download("https://x.test/a.xml", most=10, get=get)
    data = b"tar bytes"
    source = remote.ArchiveSource("s", "https://x.test/m", "1", "1", "d", "doi", "s.tgz", "https://x.test/s.tgz", "application/gzip", len(data), hashlib.sha256(data).hexdigest())
    path = remote.fetch_archive(source, str(tmp_path), get=lambda u, t: (200, {}, Reader(data)))
    assert remote.fetch_archive(source, str(tmp_path), get=None) == path
    with pytest.raises(DownloadError):
        remote.fetch_archive(source, str(tmp_path), force=True, get=lambda u, t: (200, {}, Reader(b"tar bytez")))
    with pytest.raises(SourceError):
        remote.census("https://x.test", "q", "t", {"size": 3, "results": ["a", "b"]})
    assert remote.census("https://x.test", "q", "t", {"size": 2, "results": ["b", "a"]}).first_identifier == "a"
    row = {"CID": 962, "Title": "Water", "InChIKey": "KEYB", "MolecularFormula": "H2O"}
    answer = lambda rows, status=200: lambda u, t: (status, {}, Reader(json.dumps({"PropertyTable": {"Properties": rows}}).encode()))
    assert remote.resolve_external("water", get=answer([row])).stable_identifier == "inchikey:KEYB"
    with pytest.raises(AmbiguousComponent):
        remote.resolve_external("water", get=answer([row, row | {"InChIKey": "OTHER"}]))
    with pytest.raises(ComponentNotFound):
        remote.resolve_external("water", get=answer([], 404))


def test_stream(spark, tmp_path):
    from kelvinlake.streaming.ingest import additive_rankings, ingest, stream_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_bytes(XML)
    (tmp_path / "in/b.xml").write_bytes(b"<broken")
    silver, bad = str(tmp_path / "silver"), str(tmp_path / "bad")
    ingest(stream_files(spark, str(tmp_path / "in")), silver, bad, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(bad).count() == 1
    assert summary.top(additive_rankings(spark, silver), "components", 1).first()["count"] == 6


def test_two_archives_do_not_meet(spark, tmp_path):
    for name in ("a", "b"):
        with tarfile.open(tmp_path / f"{name}.tar", "w") as tar:
            info = tarfile.TarInfo("x.xml")
            info.size = len(XML)
            tar.addfile(info, io.BytesIO(XML))
    bronze = scan.read_archive(spark, f"{tmp_path}/a.tar,{tmp_path}/b.tar")
    docs = scan.documents(scan.decode_documents(bronze))
    one = scan.documents(scan.decode_documents(scan.read_source(spark, XML)))
    got, alone = (summary.totals(x, datasets(x)).first() for x in (docs, one))
    assert list(got) == [2 * n for n in alone]
    keys = lambda x: {r.stable_id for r in identity.build_index(identity.compounds(x)).collect()}
    assert keys(docs) == keys(one)


@pytest.mark.parametrize(
    "change",
    [
        lambda x: x.replace(b"<nPropValue>0.10", b"<nPropValue>sNaN"),
        lambda x: x.replace(b"<nOrgNum>3</nOrgNum>", b"<nOrgNum>99999999999999</nOrgNum>"),
        lambda x: b'{"a": ' * 200_000,
        lambda x: as_json(x, x).replace(b"On gases", b"On \\ud800 gases"),
    ],
)
def test_one_bad_document_fails_alone(spark, change):
    bad = change(XML)
    is_json = bad[:1] == b"{"
    rows = [(0, "good", XML, None), (1, "bad", None if is_json else bad, bad if is_json else None)]
    decoded = scan.decode_documents(spark.createDataFrame(rows, scan.BRONZE)).collect()
    assert [(r.member, r.error is None, r.document is None) for r in decoded] == [("good", True, False), ("bad", False, True)]
