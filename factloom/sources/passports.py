"""Invented pages of travel documents: zones of public specimens, misread in a way that the order's number picks, and labelled lines."""

from __future__ import annotations

from factloom.sources.records import RECORDS, case

NAMES = ("ERIKSSON<<ANNA<MARIA", "MUSTER<<KIM", "BEISPIEL<LANG<<JO<ADA", "NOM<<ERIKA", "SOMMER", "WINTER<<OLE<<X")
#: The lines of the specimens after the name, by kind of zone: cards of three lines, cards of two, passports.
NUMBERS = ("7408122F1204159UTO<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6", "L898902C36UTO7408122F1204159ZE184226B<<<<<10")
_K, _BAD = "o_orderkey % 3", "o_orderkey * 7 % 13"
_NAME = case("o_custkey % 6", NAMES)


def _misread(line: str) -> str:
    """The line as it is, or with letters for digits, cut, spaced, in lower case, with one character wrong, or with a wrong sex."""
    ways = [line, f"replace({line}, '0', 'O')", f"replace({line}, '1', 'I')", f"substring({line}, 1, length({line}) - 1)", f"substring({line}, 1, length({line}) - 7)", f"substring({line}, 1, 20)", f"replace({line}, '<', ' <')", f"lower({line})"]
    ways += [f"concat(substring({line}, 1, CAST(o_orderkey % 20 AS INT)), 'B', substring({line}, CAST(o_orderkey % 20 AS INT) + 2, 60))", f"replace({line}, '8', 'B')", line, f"replace({line}, '<', '«')", f"replace({line}, 'F12', 'K12')"]
    return f"CASE {_BAD} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END"


RECORDS["zone_texts"] = f"""
    SELECT o_orderkey AS doc_id, concat(CASE WHEN {_BAD} = 10 THEN concat('ABCDEFGHIJKLMNOPQ', chr(10)) ELSE '' END, {_misread('a')}, chr(10), {_misread('b')}, CASE WHEN {_K} = 0 THEN concat(chr(10), {_misread('c')}) ELSE '' END) AS text
    FROM (SELECT o_orderkey, CASE {_K} WHEN 0 THEN 'I<UTOD231458907<<<<<<<<<<<<<<<' WHEN 1 THEN rpad(concat('I<UTO', {_NAME}), 36, '<') ELSE rpad(concat('P<UTO', {_NAME}), 44, '<') END AS a,
        CASE {_K} WHEN 0 THEN concat('{NUMBERS[0]}', CAST(o_custkey % 10 AS STRING)) WHEN 1 THEN '{NUMBERS[1]}' ELSE '{NUMBERS[2]}' END AS b, rpad({_NAME}, 30, '<') AS c
      FROM {{orders}}) z"""
_LINES = (
    ("o_orderkey % 3", ("REISEPASS", "Passport | Passeport", "Bundesrepublik Deutschland")),
    ("o_custkey % 5", ("Surname: Muster.", "Familienname: Beispiel-Lang;", "Name Musterfrau", "", "Surname: Muster")),
    ("o_orderkey % 7", ("Given names: Erika.", "Vornamen: Kim Jo,", "Given name: or pseudonym.", "", "Prénoms Ada", "Given names: Ada 7", "Vorname /")),
    ("o_custkey % 4", ("Date of issue: 01.02.2015", "Ausstellungsdatum 3/4/19", "", "Date of issue: 31.02.2015")),
    ("o_custkey % 3", ("Issuing authority: Stadt Erfurt", "Ausstellende Behörde: Stadt Eisenach,", "Autorité")),
    ("o_orderkey % 5", ("Passport No: C01X00T47", "Passnummer: CFGH12345", "", "Nr CFGHJKLMN", "Document no. X1")),
    ("o_custkey % 7", ("Nationality: DEUTSCH;", "Staatsangehörigkeit: D", "Place of birth: Berlin.", "Wohnort München", "Größe 170", "Geburtsort: Köln 1", "am 5.6.21 in Hamburg")),
)
RECORDS["passport_texts"] = f"""
    SELECT o_orderkey AS doc_id, concat({', chr(10), '.join(case(number, lines) for number, lines in _LINES)}, chr(10), CASE WHEN o_orderkey % 7 = 2 THEN '' ELSE text END) AS text
    FROM {{orders}} JOIN ({RECORDS['zone_texts']}) t ON o_orderkey = t.doc_id"""
_CARD_LINES = (
    ("o_orderkey % 5", ("Geburtsort: Köln", "place of birth  New Town", "Geburtsort Bad Ort-Süd", "", "Geburtsort:")),
    ("o_custkey % 4", ("Ausstellungsdatum: 01.02.2015", "date of issue 31.02.2015", "", "date of issue: 3-4-19")),
    ("o_custkey % 3", ("Ausstellende Behörde: Stadt Erfurt", "issuing authority   Town Hall, 2nd floor", "")),
    ("o_orderkey % 4", ("Anschrift: Am Ring 5", "", "Wohnort  Ulm", "address: 5 Mill Lane")),
    ("o_custkey % 6", ("CAN: 4O1I56", "card access number 123456", "can 99l999", "", "CAN 12345", "can: 654321")),
    ("o_orderkey % 6", ("Augenfarbe: grün", "eye colour: BROWN", "Augenfarbe violett", "", "eye color: Haselnuss", "Augenfarbe:")),
    ("o_custkey % 5", ("Größe: 172 cm", "height 300", "Körpergröße: 81cm", "", "groesse: 25")),
    ("o_orderkey % 7", ("Aufenthaltstitel: Niederlassungserlaubnis", "permit type: Blue Card", "Art des Aufenthaltstitels: Duldung nach Paragraph", "Blaue Karte EU", "", "permit type: Student  Pass", "Aufenthaltserlaubnis")),
)
RECORDS["card_texts"] = f"SELECT o_orderkey AS doc_id, concat({', chr(10), '.join(case(number, lines) for number, lines in _CARD_LINES)}) AS text FROM {{orders}}"
