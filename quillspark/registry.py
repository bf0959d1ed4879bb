"""Small fixed tables: registry of document titles, cue words, intents. Users may pass their own instead."""

from __future__ import annotations

# Chapter, title, code.
CHAPTERS = [
    ("12", "Code of Organization and Civil Procedure (Cap. 12)", "code_12"),
    ("13", "Commercial Code (Cap. 13)", "code_13"),
    ("16", "Civil Code (Cap. 16)", "code_16"),
    ("55", "Notarial Profession and Notarial Archives Act (Cap. 55)", "notarial_act"),
    ("56", "Public Registry Act (Cap. 56)", "public_registry"),
    ("79", "Commissioners for Oaths Ordinance (Cap. 79)", "commissioners_oaths"),
    ("123", "Income Tax Act (Cap. 123)", "income_tax_act"),
    ("246", "AIP Act (Cap. 246)", "aip_act"),
    ("296", "Land Registration Act (Cap. 296)", "land_registration"),
    ("364", "Duty on Documents and Transfers Act (Cap. 364)", "duty_act"),
    ("372", "Income Tax Management Act (Cap. 372)", "income_tax_mgmt"),
    ("373", "Prevention of Money Laundering Act (Cap. 373)", "money_laundering"),
    ("398", "Condominium Act (Cap. 398)", "condominium_act"),
    ("540", "Gender Identity, Gender Expression and Sex Characteristics Act (Cap. 540)", "gender_identity"),
    ("604", "Private Residential Leases Act (Cap. 604)", "residential_leases"),
    ("614", "Cohabitation Act (Cap. 614)", "cohabitation_act"),
    ("615", "Real Estate Agents, Property Brokers and Property Consultants Act (Cap. 615)", "real_estate_agents"),
    ("623.01", "EPC Regulations (S.L. 623.01)", "epc_regulations"),
]

# Code, overview.
OVERVIEWS = [
    ("code_13", "Commercial Code (Cap. 13): Malta's primary commercial law governing traders, acts of trade, bills of exchange, commercial transactions, bankruptcy, and commercial disputes."),
    ("companies_act", "Companies Act (Cap. 386): Governs company formation, structure, governance, directors' duties, share capital, distributions, financial assistance, beneficial ownership, and company records in Malta."),
    ("sl_386_02", "S.L. 386.02 (Companies Act - Private Companies Regulations): Rules for private limited liability companies including formation, registration, and operational requirements."),
    ("sl_386_03", "S.L. 386.03 (Companies Act - Public Companies Regulations): Regulations governing public limited companies including listing, disclosure, and shareholder protections."),
    ("sl_386_04", "S.L. 386.04 (Company Secretary Regulations): Requirements and duties of company secretaries, qualifications, and professional standards."),
    ("sl_386_05", "S.L. 386.05 (Beneficial Ownership Regulations): Rules for maintaining and disclosing beneficial ownership registers for companies."),
    ("sl_386_06", "S.L. 386.06 (Financial Assistance Regulations): Rules governing companies providing financial assistance for acquisition of their own shares."),
    ("sl_386_07", "S.L. 386.07 (Distribution Rules): Regulations on dividend distributions, solvency tests, and capital maintenance requirements."),
    ("sl_386_08", "S.L. 386.08 (Cell Companies Regulations): Rules for protected cell companies and incorporated cell companies structure and operations."),
    ("sl_386_09", "S.L. 386.09 (Annual Return Regulations): Requirements for filing annual returns, financial statements, and related penalties."),
    ("sl_386_10", "S.L. 386.10 (Accounting Records Regulations): Rules for maintaining proper accounting records, books, and financial documentation."),
    ("sl_386_11", "S.L. 386.11 (Directors' Duties Regulations): Detailed rules on directors' fiduciary duties, conflicts of interest, and liability."),
    ("sl_386_12", "S.L. 386.12 (Share Transfer Regulations): Procedures and requirements for transferring shares in companies."),
    ("sl_386_13", "S.L. 386.13 (Debenture Regulations): Rules for issuing, registering, and managing debentures and company debt instruments."),
    ("sl_386_14", "S.L. 386.14 (Company Name Regulations): Requirements and restrictions for company names, name changes, and registrations."),
    ("sl_386_15", "S.L. 386.15 (Liquidation Regulations): Procedures for company winding up, liquidation, and creditor protections."),
    ("sl_386_16", "S.L. 386.16 (Foreign Companies Regulations): Rules for foreign companies operating or establishing presence in Malta."),
    ("sl_386_18", "S.L. 386.18 (European Company Regulations): Rules for Societas Europaea (SE) companies operating in Malta."),
    ("sl_386_21", "S.L. 386.21 (Single Member Companies Regulations): Special rules for companies with single shareholders."),
    ("sl_386_22", "S.L. 386.22 (Investment Services Companies Regulations): Specific regulations for companies providing investment services."),
    ("sl_386_23", "S.L. 386.23 (Audit Requirements Regulations): Rules for company audits, auditor qualifications, and financial reporting."),
    ("sl_386_24", "S.L. 386.24 (Insolvency Trading Regulations): Rules prohibiting and penalizing trading while insolvent."),
    ("sl_595_27", "S.L. 595.27: Subsidiary legislation under Cap. 595 related to commercial or corporate matters."),
]

# Intents in the order they are tried, with their triggers.
INTENTS = [
    ("definition", ["what is", "define", "meaning"]),
    ("procedural", ["how to", "procedure", "process"]),
    ("penalty", ["penalty", "fine", "punishment"]),
    ("requirement", ["requirement", "duty", "obligation"]),
    ("temporal", ["when", "time", "deadline", "period"]),
]
# The same with the words that were added later.
WIDENED_INTENTS = [
    ("definition", ["what is", "define", "meaning"]),
    ("procedural", ["how to", "how does", "how do", "steps for", "procedure", "process"]),
    ("penalty", ["penalty", "penalties", "fine", "punishment", "consequences"]),
    ("requirement", ["requirement", "duty", "obligation", "obligations", "what must", "what should"]),
    ("temporal", ["when", "time", "deadline", "period"]),
]
# Words and their synonyms. Users add their own.
SYNONYMS = {
    "company": ["corporation", "limited liability company", "entity"],
    "director": ["board member", "officer", "company officer"],
    "dividend": ["distribution", "payment to shareholders"],
}
# What an answer should dwell on, by intent.
INSTRUCTIONS = {
    "definition": "Say what the terms mean and what follows from that in law.",
    "procedural": "Give the steps in their order and what each needs.",
    "penalty": "Give the penalties and when they fall due.",
    "requirement": "Give the duties, whom they bind and under which conditions.",
    "temporal": "Give the periods and deadlines and what starts them.",
}
INSTRUCTION = "Give what bears on the question."

# What an intent adds to a query.
EXPANSIONS = {
    "definition": "definition meaning interpret define term construed means",
    "procedural": "procedure process steps how to application shall apply filing",
    "penalty": "penalty fine punishment offence liable conviction contravention sanctions",
    "requirement": "requirement duty obligation must shall required compliance",
    "temporal": "time period deadline within days months not later than when",
}
# Intent, boost, cues in a chunk.
BOOSTS = [
    ("definition", 0.05, ["means", "for the purposes of this"]),
    ("procedural", 0.05, ["shall", "procedure", "steps", "application"]),
    ("penalty", 0.07, ["penalty", "fine", "liable", "offence", "contravention"]),
    ("requirement", 0.04, ["must", "shall", "required", "requirements"]),
    ("temporal", 0.04, ["days", "months", "within", "not later than"]),
]
# Explicit mentions, hinting words, corpus nudges, labels.
EXPLICIT_HINTS = [("companies_act", ["companies act", "cap. 386", "cap 386"]), ("code_13", ["commercial code", "cap. 13", "cap 13"])]
HINT_WORDS = ["company", "companies", "shareholder", "director", "distribution", "dividend", "solvency", "balance sheet", "capital maintenance", "memorandum", "articles of association", "liquidator", "winding up", "company secretary", "beneficial owner"]
NUDGES = {"companies_act": "Companies Act Cap. 386", "code_13": "Commercial Code Cap. 13"}
INTENT_LABELS = {"definition": "Definition", "procedural": "Procedure", "penalty": "Penalty / Offence", "requirement": "Requirement / Obligation", "temporal": "Timing / Deadline"}
# Words that are no keywords.
STOPWORDS = ["the", "a", "an", "is", "are", "what", "who", "where", "when", "how", "can", "do", "does", "in", "of", "to", "for", "with", "about", "malta", "code", "commercial"]
