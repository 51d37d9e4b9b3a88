"""Words that decide about candidates: families of hints, groups of fields, values that are no facts.

Fixed values, all of this module."""

from __future__ import annotations

#: Families of hints; each is looked for as a plain substring of lower-case text.
HINTS: dict[str, tuple[str, ...]] = {
    "birth": (
        "date of birth", "birth date", "geburtsdatum", "geboren", "geboren am", "born", "born on", "dob", "date naissance", "date de naissance",
        "تاريخ الميلاد",
    ),
    "issue": (
        "issue date", "date of issue", "issued", "issued on", "ausstellungsdatum", "ausgestellt", "ausgestellt am", "date delivrance",
        "date de délivrance", "تاريخ الإصدار",
    ),
    "expiry": (
        "expiry date", "expiration date", "expires", "expires on", "valid until", "gültig bis", "gueltig bis", "ablaufdatum", "ablauf am",
        "date expiration", "date d'expiration", "تاريخ الانتهاء",
    ),
    "enrollment": (
        "enrollment date", "registration date", "start date", "course start", "beginn", "anmeldung", "einschreibung", "immatrikulation",
        "تاريخ التسجيل",
    ),
    "payment": (
        "payment due", "payment due date", "due date", "due by", "pay until", "pay by", "payable until", "payment deadline", "deadline for payment",
        "zahlung bis", "zahlbar bis", "zahlbar am", "fällig am", "fällig bis", "faellig am", "faellig bis", "bis spätestens", "bis spaetestens",
        "rechnung fällig", "rechnung faellig", "invoice due", "mahnung", "zahlungserinnerung", "mahnbetrag", "überweisen bis", "ueberweisen bis",
        "آخر موعد للدفع", "تاريخ الاستحقاق", "ادفع حتى", "الدفع حتى",
    ),
    "document": (
        "document date", "letter date", "letter dated", "date of letter", "schreiben vom", "brief vom", "bescheid vom", "datum", "erstellt am",
        "created on", "ausfertigung", "bearbeitet am", "eingegangen am", "posteingang", "eingangsdatum", "druckdatum", "تاريخ الوثيقة",
        "تاريخ الخطاب",
    ),
    "legal": (
        "gesetz", "gesetzes", "gesetz vom", "verordnung", "verordnung vom", "rechtsgrundlage", "rechtsgrundlagen", "paragraph", "artikel", "abs.",
        "absatz", "sgb", "s gb", "bgb", "aufenthg", "asylg", "estg", "ao", "ustg", "§", "in kraft", "inkrafttreten", "law dated", "regulation dated",
        "legal basis", "legal reference", "قانون", "لائحة", "الأساس القانوني",
    ),
    "appointment": (
        "appointment", "termin", "vorsprache", "einladung", "meeting", "interview", "anhörung", "anhoerung", "ladung", "vorsprechen am",
        "erscheinen am", "موعد", "مقابلة",
    ),
    "coverage_start": (
        "versichert ab", "gültig ab", "gueltig ab", "valid from", "coverage from", "insurance from", "beginn der versicherung", "mitglied ab",
        "بداية التأمين",
    ),
    "coverage_end": (
        "versichert bis", "gültig bis", "gueltig bis", "valid until", "coverage until", "insurance until", "ende der versicherung", "mitglied bis",
        "نهاية التأمين",
    ),
    "employment_start": (
        "employment start", "begin of employment", "beschäftigt seit", "beschaeftigt seit", "eintritt", "arbeitsbeginn", "tätig seit", "taetig seit",
        "beginn der beschäftigung", "beginn der beschaeftigung", "بداية العمل",
    ),
    "employment_end": (
        "employment end", "end of employment", "austritt", "arbeitsende", "beschäftigt bis", "beschaeftigt bis", "ende der beschäftigung",
        "ende der beschaeftigung", "نهاية العمل",
    ),
    "contract_start": ("contract start", "vertragsbeginn", "mietbeginn", "lease start", "starts on", "beginnt am", "beginn des vertrags", "بداية العقد"),
    "contract_end": ("contract end", "vertragsende", "mietende", "lease end", "ends on", "endet am", "ende des vertrags", "نهاية العقد"),
    "invoice": ("invoice date", "rechnungsdatum", "rechnung vom", "datum der rechnung", "belegdatum", "تاريخ الفاتورة"),
    "decision": ("decision date", "bescheid vom", "entscheidung vom", "beschluss vom", "bewilligung vom", "ablehnung vom", "تاريخ القرار"),
    "tax": (
        "steuerbescheid", "finanzamt", "steuer", "tax assessment", "tax office", "einkommensteuer", "lohnsteuer", "steuerjahr", "steuernummer",
        "steuer-id", "steueridentifikationsnummer", "identifikationsnummer", "ust-id", "umsatzsteuer", "lohnsteuerbescheinigung", "elster",
        "abgabenordnung", "freibetrag", "solidaritätszuschlag", "solidaritaetszuschlag", "kirchensteuer", "ضريبة",
    ),
    "health": (
        "aok", "aok plus", "tk", "techniker krankenkasse", "barmer", "dak", "ikk", "kkh", "hkk", "krankenkasse", "pflegekasse", "gesundheitskasse",
        "versicherung", "krankenversicherung", "pflegeversicherung", "versichert", "versichertennummer", "mitgliedsnummer", "egk",
        "gesundheitskarte", "elektronische gesundheitskarte", "health insurance", "insurance provider", "coverage", "patient", "beitrag",
        "beitragssatz", "sozialversicherung",
    ),
    "business": (
        "arbeitgeber", "arbeitnehmer", "employee", "employer", "employment", "beschäftigung", "beschaeftigung", "beschäftigungsbetrieb",
        "beschaftigungsbetrieb", "beschäftigungsort", "beschaftigungsort", "firma", "company", "unternehmen", "betrieb", "lohn", "gehalt", "payroll",
        "salary", "wage", "contribution", "employee contribution", "employer contribution", "personalabteilung", "hr", "abteilung", "beruf",
        "tätigkeit", "taetigkeit",
    ),
    "bank": (
        "iban", "bic", "bank", "sparkasse", "volksbank", "deutsche bank", "commerzbank", "postbank", "bankverbindung", "zahlungsempfänger",
        "zahlungsempfaenger", "kontoinhaber", "konto", "kontonummer", "gläubiger", "glaeubiger", "mandatsreferenz", "sepa", "lastschrift",
        "überweisung", "ueberweisung", "zahlungsverkehr", "recipient bank", "creditor",
    ),
    "authority": (
        "jobcenter", "landratsamt", "wartburgkreis", "ausländerbehörde", "auslaenderbehoerde", "stadtverwaltung", "gemeinde", "amt", "behörde",
        "behoerde", "finanzamt", "bundesagentur", "agentur für arbeit", "agentur fuer arbeit", "sozialamt", "rathaus", "bürgeramt", "buergeramt",
        "einwohnermeldeamt", "familienkasse", "jugendamt", "wohngeldstelle", "ordnungsamt", "department", "authority", "public office",
    ),
    "form": (
        "formular", "vordruck", "seite", "page", "anlage", "abschnitt", "bitte", "ankreuzen", "zutreffendes", "ausfüllen", "ausfuellen", "eintragen",
        "unterschrift", "signature", "zurück", "zurdck", "zurueck", "weiter", "hinweis", "hinweise", "erklärung", "erklaerung", "datenschutzhinweis",
        "pflichtfeld", "optional",
    ),
    "address_junk": (
        "zurück", "zurdck", "zurueck", "beschäftigungsbetrieb", "beschaftigungsbetrieb", "beschäftigungsort", "beschaftigungsort", "ändert",
        "andert", "formular", "vordruck", "seite", "page", "anlage", "bitte", "ankreuzen", "ausfüllen", "ausfuellen", "unterschrift", "signature",
        "hinweis", "kundencenter", "servicecenter", "postfach", "telefon", "fax", "email", "e-mail", "www.", "http",
    ),
    "other_party": (
        "aok", "aok plus", "jobcenter", "landratsamt", "wartburgkreis", "ausländerbehörde", "auslaenderbehoerde", "stadtverwaltung", "gemeinde",
        "amt", "behörde", "behoerde", "finanzamt", "krankenkasse", "versicherung", "bundesagentur", "agentur für arbeit", "agentur fuer arbeit",
        "sozialamt", "rathaus", "telefon", "fax", "e-mail", "email", "www.", "http", "straße", "strasse", "postfach", "bankverbindung", "iban",
        "bic", "sparkasse", "volksbank", "deutsche bank", "commerzbank", "zahlungsverkehr", "servicecenter", "kundencenter",
    ),
    "organization": (
        "aok", "plus", "gmbh", "ag", "kg", "ug", "ohg", "ev", "e.v.", "amt", "behörde", "behoerde", "jobcenter", "landratsamt", "kreis", "stadt",
        "gemeinde", "versicherung", "krankenkasse", "bank", "sparkasse", "finanzamt", "bundesagentur", "agentur", "sozialamt", "rathaus",
        "verwaltung", "center", "zentrum", "service", "kundencenter", "servicecenter", "abteilung", "department", "office", "authority",
    ),
    "phone_noise": (
        "fax", "telefon", "tel.", "tel:", "phone", "hotline", "service", "kundencenter", "servicecenter", "zentrale", "durchwahl", "extension",
        "kontakt", "contact", "sprechzeiten", "öffnungszeiten", "oeffnungszeiten", "homepage", "webseite", "website", "www.", "http", "behörde",
        "behoerde", "amt", "jobcenter", "landratsamt", "finanzamt", "krankenkasse", "versicherung", "agentur für arbeit", "agentur fuer arbeit",
        "stadtverwaltung", "gemeinde", "rathaus", "postfach", "service-hotline", "kundenservice", "support", "zentrale rufnummer",
        "telefonnummer der dienststelle",
    ),
    "form_value": (
        "zurdck", "zurück", "zurueck", "weiter", "bitte", "seite", "page", "formular", "anlage", "abschnitt", "hinweis", "unterschrift", "signature",
        "ankreuzen", "ausfüllen", "ausfuellen", "eintragen",
    ),
    "reference_noise": (
        "kundencenter", "servicecenter", "jobcenter", "landratsamt", "finanzamt", "krankenkasse", "versicherung", "agentur", "bank", "sparkasse",
        "postfach", "telefon", "fax", "email", "www.", "http",
    ),
    "name_noise": (
        "betreuenden fachkraft", "fachkraft", "maßnahmeteilnehmenden", "massnahmeteilnehmenden", "ma&nahmeteilnehmenden", "teilnehmenden",
        "teilnehmer", "ansprechpartner", "sachbearbeiter", "bearbeiter", "kontaktperson", "berater", "betreuer", "dozent", "lehrer", "mitarbeiter",
        "zuständig", "zustaendig", "zuständige", "zustaendige", "unterschrift", "signature",
    ),
    "payee": (
        "zahlungsempfänger", "zahlungsempfaenger", "kontoinhaber", "bankverbindung", "empfänger", "empfaenger", "gläubiger", "glaeubiger",
        "creditor", "recipient bank",
    ),
    "street": (
        "straße", "strasse", "str.", "weg", "platz", "allee", "ring", "gasse", "ufer", "chaussee", "damm", "steig", "pfad", "markt", "street",
        "road", "avenue", "ave", "lane", "drive", "blvd",
    ),
    "office_mail": (
        "info@", "kontakt@", "service@", "post@", "mail@", "support@", "team@", "office@", "verwaltung@", "kundenservice@", "datenschutz@",
        "bewerbung@", "rechnung@", "buchhaltung@", "personal@", "hr@", "noreply@", "no-reply@", "donotreply@",
    ),
    "identity_document": (
        "passport", "reisepass", "personalausweis", "identity card", "id card", "aufenthaltstitel", "residence permit", "nationality",
        "staatsangehörigkeit", "staatsangehoerigkeit",
    ),
}
#: Families that together tell of a party other than the person.
OTHER_PARTY = ("other_party", "tax", "health", "business", "bank", "authority", "form")
#: Groups of field names.
FIELDS: dict[str, tuple[str, ...]] = {
    "evidence_only": (
        "document_label", "document_date", "letter_date", "date", "date_value", "legal_reference_date", "legal_reference", "organization_name",
        "authority_name", "office_name", "contact_email", "contact_phone", "contact_person", "organization_iban", "organization_address",
        "organization_reference", "bank_name", "bic", "employer", "employee", "tax_office", "insurance_provider", "case_worker",
        "document_reference", "page_number", "footer", "header", "form_label", "form_instruction", "form_section", "form_checkbox", "form_option",
        "form_help_text", "form_footer", "form_header", "instruction_text", "public_authority_reference", "authority_reference", "tax_reference",
        "tax_office_reference", "health_reference", "health_provider", "insurance_reference", "business_reference", "employment_reference",
        "bank_reference", "payment_reference", "invoice_reference", "legal_reference_number", "case_reference", "department_name", "service_center",
        "customer_center", "branch_name", "recipient_name", "sender_name", "company_name", "unknown_non_person", "fax", "tel", "telephone", "phone",
        "hotline", "service_phone", "authority_phone", "organization_phone", "public_phone", "support_phone", "customer_service_phone", "form_value",
        "form_noise", "ocr_fragment", "reference_noise",
    ),
    "review_only": ("review_candidate",),
    "date": (
        "date", "date_value", "birth_date", "date_of_birth", "issue_date", "issued_date", "date_of_issue", "expiry_date", "expiration_date",
        "valid_until", "due_date", "payment_due_date", "enrollment_date", "document_date", "letter_date", "legal_reference_date", "appointment_date",
        "coverage_start_date", "coverage_end_date", "employment_start_date", "employment_end_date", "contract_start_date", "contract_end_date",
        "tax_year_date", "invoice_date", "service_period_start", "service_period_end", "decision_date", "approval_date", "application_date",
        "submission_date", "processing_date", "period_start_date", "period_end_date", "valid_from", "valid_to",
    ),
    "name": ("surname", "given_names", "full_name", "first_name", "last_name"),
    "weak": ("employer", "employee", "occupation", "job_title"),
    "address": ("address", "street", "postal_address", "residence", "residential_address", "home_address"),
    "phone": ("phone_number", "phone", "telephone", "mobile", "contact_phone", "fax", "tel", "telefon"),
    "reference": (
        "reference", "reference_number", "case_number", "number", "customer_number", "insurance_number", "member_number", "tax_number",
        "file_number", "document_number",
    ),
    "protected": (
        "surname", "given_names", "full_name", "first_name", "last_name", "date_of_birth", "place_of_birth", "nationality", "sex", "gender",
        "tax_id", "iban", "phone_number", "phone", "telephone", "mobile", "email", "address", "street", "postal_address", "residence",
        "residential_address", "home_address",
    ),
    "model_review": (
        "surname", "given_names", "full_name", "date_of_birth", "place_of_birth", "nationality", "sex", "passport_number", "document_number",
        "date_of_issue", "date_of_expiry", "expiry_date", "issue_date", "issuing_authority", "eye_color", "height",
    ),
    "contact": ("email", "phone_number", "phone", "telephone", "mobile", "fax", "tel", "telefon", "contact_email", "contact_phone"),
}
#: Metadata keys whose values make a candidate's context, in order.
CONTEXT_KEYS = (
    "target_field", "label", "nearby_label", "context", "line_text", "block_text", "page_text", "left_text", "right_text", "previous_text",
    "next_text", "source_label", "document_type", "sender", "recipient", "section", "table_header", "column_header", "row_header",
    "document_title", "document_category", "issuer", "authority", "organization", "page_header", "page_footer",
)
#: Values that are labels, and values that are nothing.
LABELS = (
    "surname", "given names", "name", "date of birth", "birth date", "place of birth", "nationality", "sex", "address", "residence", "phone",
    "telephone", "telefon", "email", "e-mail", "fax", "iban", "bic", "betrag", "amount", "datum", "date", "nr", "nummer", "number",
    "kundennummer", "versichertennummer", "steuer-id", "identifikationsnummer", "prénoms", "/ prénoms", "religious name or pseudonym",
    "/ religious name or pseudonym /", "residence./ do", "arbeitgeber", "arbeitnehmer", "employee", "employer", "beschäftigungsbetrieb",
    "beschaftigungsbetrieb", "beschäftigungsort", "beschaftigungsort", "steuer", "finanzamt", "krankenkasse", "versicherung", "formular",
    "hinweis", "seite", "page",
)
JUNK = (
    "-nr", "nr", "no", "n/a", "na", "none", "null", "and by", "by", "and", "or", "of", "the", "for", "from", "to", "contribution @",
    "contribution", "employee contribution", "employer contribution", "@", "-", "/", ".", ":", ";", ",", "zurdck", "zurück", "zurueck", "weiter",
    "bitte", "seite", "page", "formular", "tel", "telefon", "phone", "fax", "hotline", "kontakt", "contact", "service", "support", "zentrale",
    "durchwahl",
)
WEAK_JUNK = ("and by", "-nr", "contribution", "contribution @", "employee", "employer", "monthly", "annual", "gross", "net")
TITLES = ("herr", "frau", "mr", "mrs", "ms", "dr", "prof")
PHONE_PREFIXES = ("004-", "004 ", "00 4", "000", "0800", "0180", "0137", "0900")
