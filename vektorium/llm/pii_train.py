"""Labelled texts for the tagger of personal information, and its training.

``python -m vektorium.llm.pii_train`` writes ``pii_model.npz`` beside this file. Training texts are made
up from a seed: values of the five types in many written forms, set into sentences, records (JSON,
YAML, CSV, SQL, XML, keyword arguments, log lines, mail headers, cards) and program lines, and lines
that look alike but hold nothing (tickets, part numbers, remotes, handles, organisations, titles).
Sentences and labels were written for this purpose and are taken from no table. Names are made of
random syllables or of common given and family names, so the tagger learns shape and surroundings.
Program text without personal information is read from Python's own standard library.

The small net's threshold is set on held-out lines so that it passes ``RECALL`` of those that hold
something; the large net and the CRF decide.
"""

from __future__ import annotations

import random
import re
import sysconfig
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np

from vektorium.llm.pii_model import N_LABELS, Net, Tagger, Trainer, char_ids, labels_of

MODEL = Path(__file__).with_name("pii_model.npz")
HIDDEN, WIDTH, SCAN_HIDDEN, SCAN_WIDTH, SCAN_STRIDE = 48, 20, 12, 8, 1
LINES, EPOCHS, SCAN_EPOCHS, SEED, RECALL = 24_000, 26, 36, 11, 0.995
#: Lines a step and the highest rate of learning, of the large and of the small net.
STEP, RATE, SCAN_STEP, SCAN_RATE = 128, 6e-3, 64, 2e-2
KINDS = {"e": "email", "p": "phone", "i": "id_number", "a": "address", "n": "name"}

Line = tuple[str, list[tuple[int, int, str]]]

_ONSET = "b br c ch d dr f fr g gr h j k kl l m n p pr qu r s sh st t th tr v w y z".split()
_VOWEL = "a e i o u ai ee ia io oa ou ei ie".split()
_CODA = ["", "", "n", "r", "l", "s", "th", "nd", "rt", "ck", "lm", "nn", "x", "mb", "rl", "w", "m", "d", "k", "g", "t", "z", "sh", "ch", "st", "ll", "ss", "p", "f", "rn", "ng", "h"]
_ENDING = "ow aw ew y ie e a o i sky ska ez wicz son sen mann feld bach gate mere holm field bridge ton combe ford ham ley well worth stead dale brook hollow marsh heim stadt burg dorf wyn quill vale edge ane elle ette ine ova off shaw wood land mark dahl berg stein hardt lohn garde moor".split()
_ACCENT = {"a": "áàäâãå", "e": "éèëê", "i": "íïî", "o": "óöøô", "u": "úüû", "n": "ñ", "c": "çč", "z": "žź", "s": "šś", "l": "ł", "y": "ý"}
_GIVEN = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Susan Thomas Jessica Daniel Sarah Karen Nancy Lisa Anna Emma Olivia Noah Liam Lucas Sofia Mateo Camila Diego Lucia Hans Greta Jürgen Heike Pierre Chloé François Amélie Giulia Marco Ivan Olga Dmitri Svetlana Henrik Astrid Lars Ingrid Akira Yuki Hiroshi Sakura Wei Li Ming Jun Ji-woo Min-ho Priya Arjun Ananya Rahul Fatima Omar Aisha Yusuf Layla Kwame Amara Chidi Zanele Thabo Leila Reza Kim Ana Fiona Angus Siobhan Declan Nguyen Linh Kofi Tariq Jane".split()
_FAMILY = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Lee Perez Thompson White Harris Clark Lewis Young King Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Dubois Moreau Laurent Lefèvre Rossi Russo Ferrari Bianchi Ivanov Petrova Kuznetsov Lindqvist Johansson Nilsson Hansen Tanaka Suzuki Sato Watanabe Wang Zhang Chen Liu Park Choi Sharma Patel Singh Gupta Khan Ahmed Hassan Mensah Okafor Nkosi Dlamini Tran Do Silva Santos Costa Novak Kowalski Horvat Doe".split()
_WORDS = "about account active after again agenda along already always amount answer archive around basket because before behind better between bottle branch bright build camera careful carry centre chance change check circle clear clock close colour common contact corner country course create daily data degree delay depend detail device double early effort empty engine enough evening every example expect extra factor family figure final finger follow forest former garden gather general giant glass handle harbour health history holiday hundred image inside island kettle kitchen language later letter little lunch manager market material meeting member memory middle minute missing mobile monday month morning mother mountain nothing number office often orange order other paper parcel people person photo picture place plain please point project quality quarter question quick reader ready reason record remote repair report result return river rough sample school season second secret service seven silver simple sister small soft sound spring station still strong summer supper system table teacher ticket today together travel tunnel under update useful value village visit water weather week white window winter without wonder yellow yesterday".split()
_LITTLE = "the a of to in and is that it for with on at this by we you be are not from or as have was will can our its has an which do but all if so no one then there when they more".split()
_PLACES = "Church Station Mill Park Bridge Market Castle School Victoria Albert King Queen Cedar Maple Elm Oak Pine Birch Willow Meadow Spring Lake River Hill Garden Abbey Chapel Union Liberty Franklin Lincoln Jefferson Washington Orchard Vine Rose Holly".split()
_STREET = "Lane Road Street Avenue Court Close Terrace Crescent Drive Way Place Square Rd Ave Blvd St St. Ln Dr. Boulevard Row Gardens Rise Ct Rd. Ave. Highway Parkway Walk Mews Hill Circle Trail".split()
_GERMAN = "straße str. strasse weg gasse allee platz ring damm ufer".split()
_FRENCH = ["rue", "avenue", "boulevard", "place", "allée", "chemin", "impasse", "quai", "route"]
_SOUTH = ["Calle", "Avenida", "Plaza", "Paseo", "Via", "Viale", "Piazza", "Corso", "Rua"]
_PARTICLE = ["van", "de", "von", "della", "van der", "de la", "di", "da", "del", "bin", "al", "ten", "dos", "le", "du", "af", "zu"]
_TOPS = "com org net io dev co.uk de fr eu info edu gov test example invalid local app ac.uk com.au nl it es pl se ch me".split()
_CODE = "Stream Cursor Matrix Queue Batch Edge Node Handle Window Frame Index Buffer Segment Parser Token Reader Writer Factory Manager Service Client Server Session Context Value Error Result Builder Config Widget Panel Table Column Row Cell Graph Cache Pool Thread Task Event Signal Logger Filter Mapper Route".split()
_SQL = "INTEGER DECIMAL NUMERIC CHARACTER VARYING NATIONAL DATE TIME ZONE LOCAL UNSIGNED SERIAL BINARY LARGE OBJECT REAL PRECISION UNIQUE REFERENCES CASCADE DEFAULT CHECK COLLATE INDEX USING HASH BTREE FOREIGN NOT NULL TEXT DOUBLE".split()
_ORG = ["Inc.", "Ltd.", "GmbH", "Corp.", "LLC", "Foundation", "Labs", "Systems", "Software", "University", "Institute", "Technologies", "Group", "Bank", "Council", "Press", "Association", "Project", "Team", "Authors", "Contributors", "Committee"]
_KEYS = {
    "n": ["name", "fullName", "full_name", "customer", "contact", "owner", "patient", "holder", "recipient", "author", "person", "client", "Name", "FULL NAME", "employee", "display_name", "applicant", "tenant", "signatory", "maintainer", "created_by", "assignee", "traveller", "student"],
    "p": ["phone", "tel", "mobile", "telephone", "cell", "fax", "phone_number", "phoneNumber", "Tel.", "contact_no", "work_phone", "landline", "emergency", "PHONE", "Mobile", "hotline"],
    "e": ["email", "e-mail", "mail", "contact_email", "from", "to", "reply_to", "Email", "E-Mail", "EMAIL", "emailAddress", "cc", "login", "recovery_email", "address_mail"],
    "i": ["ssn", "SSN", "passport", "passport_no", "nin", "NINO", "national_id", "id_number", "tax_id", "licence_no", "driver_license", "identity_card", "document_no", "account_no", "personal_id", "insurance_no", "social security number", "Passport No", "ID card", "bank account", "national insurance number"],
    "a": ["address", "addr", "home", "home_address", "ship_to", "postal_address", "residence", "billing", "Address", "ADDRESS", "deliveryAddress", "street_address", "lives_at", "mailing address", "location"],
}
_PROSE = """
{n} suggested this rewrite|idea from {n}, {w}|patch by {n} <{e}>|{w} with help from {n} and {n}|maintained by {n}|owner is {n}|we talked it over with {n}|{n} owns this module|approved: {n}
translated by {n}|an interview with {n}, {w}|Dear {n},|Hi {n},|Hello {n}, {w}|Mr. {n} {w}|Mrs {n}|Dr. {n} {w}|Prof. {n}|Best regards, {n}|Yours sincerely, {n}|-- {n}|@author {n}|Author(s): {n}, {n}|authors = ["{n} <{e}>", "{n} <{e}>"]
Copyright (C) {y} {n}|(c) {y} {n} <{e}>|Copyright {y} by {n}. {w}|© {y}, {n}|Signed-off-by: {n} <{e}>|Reviewed-by: {n}|Tested-by: {n} <{e}>|Assigned to {n}|meeting with {n} {w}|{n} wrote:|On Tuesday {n} wrote:|{n} and {n} {w}|{w} {n} {w}
a note to {n}: {w}|the patient {n} was admitted {w}|customer {n} rang {w}|tenant {n} {w}|employee {n} ({i})|{n} ({e})|{n} - {p}|{n}, {a}|{n}; {p}; {e}|witness: {n}|signed, {n}|many thanks, {n}|any questions? see {n}|according to {n} {w}|{n} said that {w}|kudos to {n}|@{n} {w}
asked {n} about {w}|{w}, says {n}|{n} told {n} {w}|{n} (née {n})|my colleague {n} {w}|spoke to {n} on {p}|meet {n} at {a}|{n} resides at {a}|parcel for {n}, {a}|deliver it to {n}, {a}|{n} can be reached on {p}|{n} has passport {i}|{n}, born {y}, {i}|{n}'s number is {p}
bill to: {n}, {a}, {e}|please forward to {e}|write me at {e}|send {w} to {e}|mail {e} {w}|e-mail me ({e})|{e} is my address|bug reports: {e}|contact: {e}|<{e}>|mailto:{e}|for help, {e} or {p}|subscribe via {e}|CC: {e}, {e}|{e} bounced|user {e} logged in|from {e} to {e}|{e}, {e} and {e}
invite {e}|reset link sent to {e}|{w} ({e})|{w} {e} {w}|give me a call: {p}|phone {p}|tel: {p}|tel. {p} {w}|text me on {p}|you can reach us under {p}|fax number {p}|dial {p} for {w}|{p} (office)|{p} (mobile)|emergency line {p}|whatsapp {p}|the front desk is {p}|P: {p}|T {p} F {p}|M: {p}
{p} or {p}|voicemail at {p}|SMS to {p}|my new number: {p}|{w} {p} {w}|call {p}, then {w}|callback {p}|tel:{p}|ring {p} or mail {e}|lost passport {i}|passport number {i} {w}|social security {i}|SSN {i}|SSN: {i}, {w}|my ID is {i}|identity card {i}|NI no. {i}|tax number {i}|driving licence {i}|licence: {i}
account holder {n}, no. {i}|IBAN {i}|{n}, ssn {i}|card of {n} is {i}|document {i} belongs to {n}|{w} (passport {i})|national id {i}|we live at {a}|moved to {a}|visit us: {a}|{a}|office at {a}|{w} {a} {w}|post it to {a}|Our shop, {a}, {w}|warehouse: {a}|from {a} to {a}|home address {a}; {p}
as {n} said {w}|when {n} {w}|if {n} and {n} {w}|because {n} {w}|while {n} asked {n} to {w}|since {n} {w}, {n} {w}|once {n} heard that {n} {w}|{w} {n}, {a}|to {n}, {a}|for {n} at {a}|{w} to {n} at {a} {w}|{w} {e} and {e} {w}|{e} or {e}|{i} ({n})|{w}: {i}|her SSN was {i}, {w}|applicant {i} {w}
{n} <{e}> {p}|{n} | {e} | {p}|{n}: {e}|{n}, {p}|{n} / {e}|{n} [{e}]|{n}, tel. {p}, {a}|{e} ({n})|{p} - {n}|{a} ({n})|# {n}, {y}-{m}-12: {w}|{w} was {n}|{n} joined the call|{n} left {w}|voted: {n}, {n}, {n}|present: {n}; {n}; {n}
"""
_BARE = r"""
ticket {d3}-{d2}-{d4} {w}|case {d3}-{d2}-{d4}|{w} ticket {d3}-{d3}-{d4}|part number {d3}-{d3}-{d4}|part {d3}-{d2}-{d4} {w}|REF {d3}-{d3}-{d4}|order no. {d9}|order {d6}-{d3} {w}|invoice {d9}|serial {U2}{d7}|serial no {d3}-{d2}-{d4}|model {U}{d7}|SKU {U2}{d6}{U}|asset {d3}-{d2}-{d4}|bug {d3}-{d3}-{d4}
issue #{d5} and #{d4}|batch {d9} {w}|tracking {d12}|revision {d3}.{d3}.{d4}|build {d10}|lot {U2} {d2} {d2} {d2} {U}|ISBN {d3}-{d}-{d2}-{d6}-{d}|released {y}-{m}-{m} {w}|{y}-{m}-{m}T{m}:{d2}:{d2}Z {w}|uuid {h8}-{h4}-{h4}-{h4}-{h12}|sha {h40}|0x{h8} {w}|bind {ip}:{d4}|{ip} - - [{m}/Mar/{y}]|lat {d2}.{d5}, lon -{d2}.{d5}|{d12} ns, {d9} bytes
seed = {d9}|timeout={d4}, retries={d}|epoch {d10}|[{d3}, {d3}, {d4}, {d2}]|{d3} {d3} {d4} {w}|-{d3} +{d4} lines|v{d}.{d2}.{d}-{h8}|chapter {d2} {w}|page {d3}-{d3}|rgb({d3}, {d3}, {d3})|{d}e-{d2} {d}.{d6}|port {d5}, pid {d6}|git clone git@{host}:{x}/{x}.git|remote git@{host}:{x}/{x} {w}|origin ssh://git@{host}/{x}/{x}.git|https://{host}/{x}/{x}.git|pull from git@{host}:{x}/{x}
postgres://{x}:{pw}@{host}:{d4}/{x}|amqp://{x}:{pw}@{host}/{x}|url = "mysql://{x}:{pw}@{host}:{d4}/{x}"|redis://:{pw}@{host}:{d4}|DATABASE_URL={x}://{x}:{pw}@db.{host}:{d4}|ssh {x}@{ip}|@{x}/{x}@{d}.{d2}.{d}|"@{x}/{x}": "^{d}.{d}.{d}"|npm i {x}@{d}.{d}.{d}|import {x} from "@{x}/{x}";|require @{x}/{x}|image: {x}@sha256:{h40}|@{x} {w}|ping @{x} or @{x}|thanks @{x}!|by {x}_{d2}|user {x}{d2} {w}
@{x}.{x}({w})|@{X}({x}={d})|y = a @ b + {x}|{w} at {w} dot {x}|meet at noon, dot the {w}|look at the dot of {w}|scan at {d} dot {x}|@media (max-width: {d3}px)|{g} {w}|ask {g} {w}|as {g} said, {w}|grateful to {g}|{w} by {g}|{g}'s {w}|{g} and {g} {w}|see {f}, {y}|{f} {y}, {w}|the {f} filter {w}|{f}'s method {w}|Dear {g},|Hi {g}, {w}
(c) {y} {o}|Copyright {y} {o}|Copyright (c) {y} The {o}|© {o} {y}|{o} {w}|{w} {o}|signed by {o}|published by {o}|client: {o}|customer: "{o}"|{T}|{T}: {w}|{T} {T}|# {T}|## {T}|the {T} {w}|{S}. {S}.|{S}; {w}|{S}, {S}|class {C}({C}):|class {C} extends {C} {|public {C} {x}({C} {x});|{C}.{C} {x} = new {C}();|raise {C}("{S}")|{C}: {S}
@param {{C}} {x} {w}|@return {C} {w}|:class:`{C}` {w}|<{C} {x}={d} />|SELECT {x}, {x} FROM {x} WHERE {x} = {d9}|CREATE TABLE {x} ({x} INTEGER PRIMARY KEY, {x} CHAR({d2}))|INSERT INTO {x} VALUES ({d4}, '{x}')|{x} VARCHAR({d3}) DEFAULT NULL,|ALTER TABLE {x} ADD COLUMN {x} DECIMAL({d}, {d})|DO NOT MODIFY, {w}|{W}|{W} {W}|TODO({x}): {w}|FIXME {S}|NOTE: {S}
{street}, {w}|corner of {street} and {street}|near {street}|the {town} office {w}|{town} and {town} {w}|{town}, {y}|Monday Morning in {town}|from {town} to {town}|{b64}|{b64}{b64}|-----BEGIN {W} KEY-----|{x}.{x}({x}=>{x}.{x}!=={d}&&{x}({x}));return {x}.{x}|for({x}={d};{x}<{d4};{x}++){{x}[{x}]={d}}|func ({x} *{C}) {X}({x} {x}.{C}) error {|fn {x}(&self, {x}: &{C}) -> {C}<{C}> {
{x} {Q},|{x} {Q}|{x} {Q}, {x} {Q}, {x} {Q})|ALTER TABLE {x} ADD {x} {Q};|{Q}|{x} {x}. DO NOT CHANGE BY HAND|{x}. DO NOT TOUCH|{x} {x}. {W}.|address 0x{h8} near {d2}.{d4}|0x{h8}, {d2}.{d5} {w}|{d3} at {d2}.{d3}|{d2}. {S} {d2} {w}|{d}. {S} {d3}|{N} {w}. {N}|{x}: {N} {w}|isbn {d3}-{d}-{d3}-{d5}-{d} {w}|{x}({x}) ({x})
{x} CHARACTER VARYING({d2}),|{x} TIMESTAMP WITH TIME ZONE,|{x} UNSIGNED INTEGER DEFAULT {d},|{x} BIT VARYING, {x} BIG SERIAL,|CONSTRAINT {x} UNIQUE ({x})|@param{{C}}{x}|@{x}{{C}}|@type {{C}} {x} {w}|@throws {{C}} {w}|\{x}{{x}}{{x}}|{H}|{H}: {x}|X-{H}: {w}|License: {H}|{w} {H} {w}
{w} {d2} {street} {w}|{d} {street} {w}|{town}|in {town}|{w} {town} {w}|{K} {S}|{K} {S}. {K} {S}.|{K} {w}|new {K}({x})|{K}, {K} and {K} {w}|{C} {K}: {S}|{K} {T}|{S} {K} {w}
{d3}.{d5}, {d2}.{d5}|at {d2}.{d4}, -{d3}.{d4} {w}|geo: {d2}.{d6} {d3}.{d6}|+{d3} -{d3} {w}|{d4} insertions, {d3} deletions (+{d4} -{d3})|id={d9} {w}|"id": {d10},|uid={d6} gid={d4}|request id {d9} {w}|ref {d8}{U} {w}|hash {U2}{d7}|{x}_id = {d9}|rowid {d10}
{w} at {x}.{x}|{w} at {x}.{x} {w}|see {x}.{x} and {x}.{x}|from {x}.{x} import {x}|{x}.{x}.{x}|file {x}.{x}, line {d3}|{C} {S}|{C} {S} {C} {w}|{C}.{x} {S}|{W} {W} ({W}),|{W} {W} {W};|{N}|{N}. {N}.|{N}, {N}|{S} {N}|SET {W} = {d4}|DECLARE {x} {W} {W}|{U2}{d2} {U2}{d3} {w}|{g}: {w}|{f} {w}|{w} ({g}) {w}
{x} := make(map[string]{C}, {d2})|if err := {x}.{X}({x}); err != nil {|#include <{x}/{x}.h>|#define {W} {d4}|{x}: {x}|{x} = {d5}|"{x}": {d9},|"{x}": "{x}"|<a href="https://{host}/{x}">{T}</a>|License: {T} License {d}.0|SPDX-License-Identifier: {C}-{d}.0|Produced by {x}. {S}|{S} {d2} {w}. {S}|- {S}|* **{x}** {w}|Section {d}: {T}|{T}, {d2} {w}|{T} ({d4})
"""


class Maker:
    """Makes labelled lines."""

    def __init__(self, seed: int, programs: list[str] | None = None):
        self.r = random.Random(seed)
        cut = lambda s: [x for line in s.strip().split("\n") for x in line.split("|")]
        self.prose, self.bare, self.programs = cut(_PROSE.replace(" | ", " \x01 ")), cut(_BARE), programs or ["return self.value"]

    def pick(self, xs):
        return xs[int(self.r.random() * len(xs))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    # words -------------------------------------------------------------------------------------------

    def syllables(self, lo: int, hi: int) -> str:
        return "".join(self.pick(_ONSET) + self.pick(_VOWEL) + (self.pick(_CODA) if self.chance(0.6) else "") for _ in range(self.r.randint(lo, hi)))

    def word(self) -> str:
        k = self.r.random()
        return self.pick(_LITTLE) if k < 0.4 else self.pick(_WORDS) if k < 0.85 else self.syllables(1, 3)

    def words(self, lo: int = 1, hi: int = 6) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        s = self.words(3, 10)
        return s[0].upper() + s[1:]

    def foreign(self) -> str:
        """A sentence of another language, with accents and, in some, capitals on nouns."""
        nouns = self.chance(0.4)
        w = [self.accent(self.accent(self.syllables(1, 3))) for _ in range(self.r.randint(3, 9))]
        w = [x.capitalize() if i == 0 or nouns and self.chance(0.3) and not w[i - 1][0].isupper() else x for i, x in enumerate(w)]
        return " ".join(w)

    def title(self) -> str:
        return " ".join(self.pick(_WORDS).capitalize() for _ in range(self.r.randint(2, 5)))

    def proper(self, lo: int, hi: int) -> str:
        """A capitalised made-up word with one of many endings."""
        w = self.syllables(lo, hi - 1 if hi > lo and self.chance(0.5) else hi)
        return self.accent(w + self.pick(_ENDING) if self.chance(0.5) else w).capitalize()

    def accent(self, w: str) -> str:
        at = [i for i, c in enumerate(w) if c in _ACCENT]
        if at and self.chance(0.2):
            i = self.pick(at)
            w = w[:i] + self.pick(_ACCENT[w[i]]) + w[i + 1 :]
        return w

    def ident(self) -> str:
        w = [self.pick(_WORDS) if self.chance(0.7) else self.syllables(1, 2) for _ in range(self.r.randint(1, 3))]
        k = self.r.random()
        return "_".join(w) if k < 0.4 else w[0] + "".join(x.title() for x in w[1:]) if k < 0.8 else "-".join(w) if k < 0.9 else w[0]

    def camel(self) -> str:
        return "".join(self.pick(_CODE) for _ in range(self.r.randint(1, 3)))

    def digits(self, n: int) -> str:
        return "".join(self.pick("0123456789") for _ in range(n))

    def hexes(self, n: int) -> str:
        return "".join(self.pick("0123456789abcdef") for _ in range(n))

    def capitals(self, n: int) -> str:
        return "".join(self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def host(self) -> str:
        h = self.pick([self.syllables(1, 3), self.syllables(1, 3), self.pick(_WORDS), "mail." + self.syllables(1, 2), self.syllables(1, 2) + "-" + self.pick(_WORDS), "example", "dev." + self.syllables(1, 2), self.pick(_WORDS) + "." + self.syllables(1, 3), "mail.example"])
        return f"{h}.{self.pick(_TOPS)}"

    # values ------------------------------------------------------------------------------------------

    def given(self) -> str:
        w = self.pick(_GIVEN) if self.chance(0.25) else self.proper(1, 2)
        return w + "-" + self.syllables(1, 2).capitalize() if self.chance(0.04) else w

    def family(self) -> str:
        if self.chance(0.25):
            return self.pick(_FAMILY)
        w, k = self.proper(1, 3), self.r.random()
        if k < 0.07:
            return self.pick(["O'", "D'", "O’", "Mc", "Mac", "De", "Le", "Van"]) + w
        if k < 0.13:
            return self.pick(["Saint-", self.proper(1, 2) + "-"]) + w
        return w

    def name(self) -> str:
        g, f = self.given(), self.family()
        if self.chance(0.12):
            f = self.pick(_PARTICLE) + " " + f
        if self.chance(0.14):
            return f"{f}, {g}" + (f" {self.capitals(1)}." if self.chance(0.2) else "")
        k = self.r.random()
        if k < 0.16:
            g += f" {self.capitals(1)}."
        elif k < 0.2:
            g = self.pick([f"{self.capitals(1)}. {self.capitals(1)}.", f"{g} {self.capitals(1)}", f"{g} {self.capitals(1)}. {self.capitals(1)}.", f"{self.capitals(1)}."])
        elif k < 0.23:
            g += " " + self.given()
        n = f"{g} {f}"
        if self.chance(0.02):
            return f"{self.pick(_GIVEN)} {self.pick(_FAMILY)}".lower()
        return n.upper() if self.chance(0.06) else f"{g} {f.upper()}" if self.chance(0.02) else n

    def email(self) -> str:
        g, f, n = self.syllables(1, 3), self.syllables(1, 4), self.r.randrange(1, 99)
        if self.chance(0.3):
            g, f = self.pick(_GIVEN).lower(), self.pick(_FAMILY).lower()
        local = self.pick([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{g}-{f[0]}", f"{f}+{self.pick(_WORDS)}", f"{g}{n}", f"{f}", f"{g}{f}", f"{g}-{f}", f"{f}.{g}{n}", self.pick(_WORDS), f"{g[0]}.{f}"])
        host = self.host()
        k = self.r.random()
        if k < 0.3:
            at, dot = self.pick([(" at ", " dot "), (" at ", " dot "), ("[at]", "[dot]"), ("[at]", "."), (" (at) ", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" [at] ", "."), ("{at}", "."), (" <at> ", "."), (" AT ", " DOT "), ("_at_", "."), (" {at} ", " {dot} "), (" @ ", ".")])
            out = local.replace(".", dot if self.chance(0.15) else ".") + at + host.replace(".", dot)
        else:
            out = f"{local}@{host}"
        return out.upper() if self.chance(0.06) else out.title() if self.chance(0.02) else out

    def phone(self) -> str:
        d = self.digits
        a, b, c = self.pick([d(3), d(3), "555"]), self.pick([d(3), "555"]), d(4)
        k = self.r.randrange(26)
        p = [
            f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"1-{a}-{b}-{c}", f"{b}-{c}", f"+1 ({a}) {b}-{c}", f"{a} {b} {c}",
            f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"+44 (0){d(4)} {d(3)} {d(3)}", f"0{d(2)}/{d(8)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)}{d(9)}", f"0{d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"(0{d(3)}) {d(6)}",
            f"+{d(2)}-{d(2)}-{d(4)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(3)}-{d(7)}",
        ][k]
        return p + self.pick([" ext. ", " ext ", " x", ", ext. ", "x", " extension ", " Ext."]) + d(self.r.randint(2, 4)) if self.chance(0.1) else p

    def id_number(self) -> str:
        d, u = self.digits, self.capitals
        s = self.pick(["-", "-", " ", ""])
        pre = u(2)
        return self.pick([
            lambda: f"{d(3)}{s}{d(2)}{s}{d(4)}", lambda: f"{d(3)}{s}{d(2)}{s}{d(4)}", lambda: f"{u(2)}{d(7)}", lambda: f"{u(1)}{d(8)}", lambda: f"{pre}{d(6)}{u(1)}",
            lambda: f"{pre} {d(2)} {d(2)} {d(2)} {u(1)}", lambda: f"{d(6)}-{u(1)}{d(3)}", lambda: f"{d(9)}", lambda: f"{d(8)}{u(1)}", lambda: f"{d(6)}-{d(4)}", lambda: f"{u(3)}{d(6)}", lambda: f"{d(3)} {d(3)} {d(3)}",
            lambda: f"{u(2)}{d(2)} {u(4)} {d(4)} {d(4)} {d(2)}", lambda: f"{u(2)}{d(20)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", lambda: f"{d(10)}",
        ])()

    def town(self) -> str:
        return self.proper(1, 2) + (self.pick([" upon " + self.proper(1, 1), " " + self.proper(1, 2), "-" + self.proper(1, 1)]) if self.chance(0.08) else "")

    def street(self) -> str:
        s = self.pick(_PLACES) if self.chance(0.35) else self.proper(1, 2)
        if self.chance(0.25):
            s += " " + (self.pick(_PLACES) if self.chance(0.5) else self.proper(1, 2))
        if self.chance(0.18):
            s = self.pick(["Old ", "Saint ", "New ", "Upper ", "North ", "St. ", "Great ", "West ", "High ", "Lower ", "N. ", "East "]) + s
        return s

    def address(self) -> str:
        d, n = self.digits, self.r.randint
        street = self.street()
        post = f"{self.capitals(1)}{self.pick(['', *'ABKXYZ'])}{n(1, 29)} {n(1, 9)}{self.capitals(2)}"
        k = self.r.random()
        if k < 0.42:
            unit = self.pick(["", "", f" #{n(1, 99)}", f", Apt {n(1, 60)}{self.pick(['', 'A', 'B'])}", f", Unit {n(1, 99)}", f", Suite {n(100, 999)}", f" Apt. {n(1, 60)}"])
            gap = self.pick([", ", ", ", ", ", " "])
            return f"{n(1, 9999)} {street} {self.pick(_STREET)}{unit}{gap}{self.town()}{self.pick([', ', ', ', ' '])}{self.capitals(2)} {d(5)}{self.pick(['', '', '', '-' + d(4)])}"
        if k < 0.64:
            flat = self.pick([f"Flat {n(1, 40)}{self.pick(['', '', 'A'])}, ", f"Apartment {n(1, 40)}, ", f"{self.proper(1, 2)} House, "]) if self.chance(0.45) else ""
            return f"{flat}{n(1, 999)}{self.pick(['', '', '', 'a', 'B'])} {street} {self.pick(_STREET)}{self.pick([', ', ', ', ' '])}{self.town()}{self.pick([' ', ', ', ' '])}{post}"
        if k < 0.82:
            w = street.replace(" ", "") + self.pick(_GERMAN) if self.chance(0.75) else street + " " + self.pick(["Weg", "Allee", "Ring", "Straße", "Platz"])
            return f"{w} {n(1, 180)}{self.pick(['', '', 'a', 'b'])}{self.pick([', ', ', ', ', ', ' '])}{self.pick(['', '', 'D-'])}{d(5)} {self.town()}"
        if k < 0.93:
            return f"{n(1, 180)}{self.pick(['', ' bis', ',', ''])} {self.pick(_FRENCH)} {self.pick(['du ', 'de la ', 'des ', '', 'de ', 'l’'])}{street}, {d(5)} {self.town()}"
        return self.pick([f"{self.pick(_SOUTH)} {street} {n(1, 180)}, {d(5)} {self.town()}", f"{self.proper(1, 2)}straat {n(1, 180)}, {d(4)} {self.capitals(2)} {self.town()}", f"{self.proper(1, 2)}vägen {n(1, 90)}, {d(3)} {d(2)} {self.town()}"])

    def value(self, kind: str) -> str:
        return {"n": self.name, "e": self.email, "p": self.phone, "i": self.id_number, "a": self.address}[kind]()

    # lines -------------------------------------------------------------------------------------------

    def filler(self, slot: str) -> str:
        """What stands for a slot that is no value."""
        if slot in KINDS:
            return self.value(slot)
        if slot[0] in "dhU" and slot != "host":
            n = int(slot[1:] or 1)
            return {"d": self.digits, "h": self.hexes, "U": self.capitals}[slot[0]](n)
        made: dict[str, Callable[[], str]] = {
            "w": lambda: self.words(1, 6), "W": lambda: self.words(1, 4).upper(), "x": self.ident, "X": lambda: self.ident().title().replace("_", "").replace("-", ""), "C": self.camel, "T": self.title, "S": self.sentence,
            "y": lambda: str(self.r.randint(1950, 2030)), "m": lambda: f"{self.r.randint(1, 12):02d}", "g": self.given, "f": self.family, "host": self.host, "ip": lambda: ".".join(str(self.r.randint(0, 255)) for _ in range(4)),
            "o": lambda: f"{self.pick([self.proper(1, 3), self.title(), self.pick(_WORDS).capitalize(), self.camel()])} {self.pick(_ORG)}" + (" " + self.pick(_ORG) if self.chance(0.2) else ""),
            "N": self.foreign, "Q": lambda: " ".join(self.pick(_SQL) for _ in range(self.r.randint(1, 3))), "H": lambda: "-".join(self.pick([self.pick(_WORDS).capitalize(), self.camel(), self.proper(1, 2)]) for _ in range(self.r.randint(2, 3))), "K": lambda: "".join(self.pick(_WORDS + _CODE).capitalize() for _ in range(self.r.randint(2, 3))), "town": self.town, "street": lambda: f"{self.street()} {self.pick(_STREET)}",
            "pw": lambda: "".join(self.pick("abcdefgABCDEFG0123456789xyzXYZ") for _ in range(self.r.randint(6, 20))), "b64": lambda: "".join(self.pick("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(self.r.randint(20, 60))),
        }
        return made[slot]()

    def fill(self, form: str) -> Line:
        text, spans = "", []
        for i, part in enumerate(re.split(r"\{([a-zA-Z]+\d*)\}", form.replace("\x01", "|"))):
            if i % 2 == 0:
                text += part
                continue
            v = self.filler(part)
            if part in KINDS:
                spans.append((len(text), len(text) + len(v), KINDS[part]))
            text += v
        return text, spans

    def record(self) -> Line:
        """Fields of a record in one of many notations; some hold nothing."""
        fields = [self.pick("nnneeppiia") for _ in range(self.r.randint(1, 4))] + ["x"] * self.r.randint(0, 2)
        self.r.shuffle(fields)
        keys = [self.pick(_KEYS[k]) if k in _KEYS else self.pick(["status", "count", "amount", "city", "role", "level", "color", "ticket", "order_no", "part_no", "sku", "build", "company", "team", "created", "hash", "title", "product"]) for k in fields]
        plain = lambda key: self.filler({"ticket": "d9", "order_no": "d9", "part_no": "d9", "hash": "h12", "company": "o", "team": "o", "title": "T", "product": "T", "city": "town"}.get(key, self.pick(["d3", "x", "d5", "w"])))
        values = [self.value(k) if k in KINDS else plain(key) if key not in ("ticket", "part_no") or self.chance(0.4) else self.fill("{d3}-{d3}-{d4}" if self.chance(0.5) else "{d3}-{d2}-{d4}")[0] for k, key in zip(fields, keys)]
        q = self.pick(['"', '"', "'"])
        style = self.r.randrange(16)
        open_, pre, mid, post, sep, close, quoted = [
            ("{", q, q + ": ", "", ", ", "}", True), ("{", "", ": ", "", ", ", "}", True), (self.ident() + "(", "", "=", "", ", ", ")", True), ("", "", ": ", "", "; ", "", False), ("", "", "=", "", " ", "", True),
            ("", None, "", "", ",", "", False), ("", None, "", "", ";", "", False), ("", None, "", "", "\t", "", False), ("| ", None, "", "", " | ", " |", False), (f"INSERT INTO {self.ident()} VALUES (", None, "", "", ", ", ");", True),
            (f"<{self.ident()} ", "", "=", "", " ", "/>", True), ("(", None, "", "", ", ", "),", True), (f"{self.ident()}.{self.pick(['add', 'append', 'push', 'insert', 'create'])}([", None, "", "", ", ", "])", True),
            ("", "", ": ", "", ", ", "", False), ("<li>", "", ": ", "", "</li><li>", "</li>", False), (self.camel() + "{", "", ": ", "", ", ", "}", True),
        ][style]
        text, spans = open_, []
        for j, (k, key, v) in enumerate(zip(fields, keys, values)):
            text += (sep if j else "") + ((pre + key.replace(" ", "_" if style in (2, 4, 10, 15) else " ") + mid) if pre is not None else "") + (q if quoted else "")
            if k in KINDS:
                spans.append((len(text), len(text) + len(v), KINDS[k]))
            text += v + (q if quoted else "") + post
        return text + close, spans

    def labelled(self) -> Line:
        """A label, a separator and a value, with or without words behind."""
        kind = self.pick("nepiiax")
        label = self.pick(_KEYS[kind]) if kind in _KEYS else self.pick(["ticket", "order no.", "part", "invoice", "serial number", "case", "article", "isbn", "ISBN", "ean", "batch", "version", "rev", "model", "tracking no."])
        made = self.value(kind) if kind in KINDS else self.fill(self.pick(["{d3}-{d2}-{d4}", "{d3}-{d3}-{d4}", "{d9}", "{U2}{d7}", "{d3}-{d}-{d2}-{d6}-{d}", "{d3}-{d}-{d4}-{d4}-{d}", "{d}-{d3}-{d5}-{d}", "{U}{d8}", "{d4}.{d2}.{d3}", "{d12}"]))[0]
        label = label.upper() if self.chance(0.08) else label.capitalize() if self.chance(0.1) else label
        text = (self.words(1, 4) + " " if self.chance(0.3) else "") + label + self.pick([": ", "=", " = ", " ", ":", " - ", " is ", " #", "; ", " no. ", " := ", " => "])
        return text + made + (self.pick([" ", ", ", "; ", " (", " - ", ". ", " # "]) + self.words(1, 7) if self.chance(0.6) else ""), [(len(text), len(text) + len(made), KINDS[kind])] if kind in KINDS else []

    def wrap(self, line: Line, lead: str, tail: str) -> Line:
        return lead + line[0] + tail, [(a + len(lead), b + len(lead), k) for a, b, k in line[1]]

    def join(self, a: Line, gap: str, b: Line) -> Line:
        n = len(a[0]) + len(gap)
        return a[0] + gap + b[0], a[1] + [(x + n, y + n, k) for x, y, k in b[1]]

    def piece(self) -> Line:
        k = self.r.random()
        if k < 0.32:
            return self.fill(self.pick(self.prose))
        if k < 0.42:
            return self.labelled()
        if k < 0.5:
            return self.record()
        if k < 0.58:  # a value as a literal in a program
            q = self.pick(['"', "'", '"', "`"])
            return self.wrap(self.fill(f"{{{self.pick('nepan')}}}"), self.pick([self.ident() + " = ", self.ident() + "(", f"const {self.ident()} = ", "return ", self.ident() + ": ", "- ", f"{self.ident()}.{self.ident()}(", "[", "assert x == "]) + q, q + self.pick(["", ")", ";", ",", "];", ") {"]))
        if k < 0.85:
            return self.fill(self.pick(self.bare))
        return self.pick(self.programs), []

    def line(self) -> Line:
        out = self.piece()
        if self.chance(0.2):
            out = self.join(out, self.pick(["; ", " ", ". ", " / ", "  ", ", ", " # ", " // ", " - ", ": "]), self.piece() if self.chance(0.6) else (self.words(2, 12), []))
        if self.chance(0.12):
            out = self.join((self.pick([self.words(2, 10), self.sentence() + ".", self.title()]), []), self.pick([" ", ": ", ". ", " - ", ", "]), out)
        lead = self.pick(["", "", "", "", "// ", "# ", "* ", "/* ", "-- ", "/// ", "> ", '"', f"{self.ident()}(\"", "<!-- ", "; ", "- ", "% ", "''' ", "<p>", "* @note ", "print('", '"""', "1. ", "﻿"])
        tail = {"/* ": self.pick([" */", ""]), "<!-- ": " -->", '"': self.pick(['",', '"', '"'  ")"]), "''' ": " '''", "<p>": "</p>", "print('": "')", '"""': '"""'}.get(lead, self.pick(["", "", "", "", "\r", " ", ".", ",", ";"]) if not lead.endswith('("') else '")' + self.pick(["", ";"]))
        text, spans = self.wrap(out, lead, tail)
        if self.chance(0.02) and spans:  # broken encoding of accents
            text = "".join("�" if ord(c) > 127 and self.chance(0.7) else c for c in text)
        return text, spans


def program_lines(seed: int, most: int = 40_000) -> list[str]:
    """Lines of the standard library without anything that might be personal: no @, two capitalised words or six digits in a row."""
    files = sorted(p for p in Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))
    doubtful = re.compile(r"@|\d{6}|\d{3}[- .]\d{3}|\b[A-ZÀ-Þ][\w.'’-]*,? (?:\w+ )?[A-ZÀ-Þ]|\(at\)| at .* dot ")
    lines = [x.strip() for p in files for x in p.read_text("utf-8", "replace").split("\n")]
    lines = [x for x in dict.fromkeys(lines) if 8 < len(x) < 240 and not doubtful.search(x)]
    random.Random(seed).shuffle(lines)
    return lines[:most]


def batches(lines: list[Line], size: int, rng: np.random.Generator):
    """Padded (ids, labels, lengths) of lines of like length, in random order."""
    order = np.argsort([len(x[0]) + rng.random() * 8 for x in lines])
    cuts = [order[k : k + size] for k in range(0, len(order), size)]
    for k in rng.permutation(len(cuts)):
        part = [lines[i] for i in cuts[k]]
        lengths = np.array([len(x[0]) for x in part])
        ids, y = np.zeros((lengths.max(), len(part)), np.int64), np.zeros((lengths.max(), len(part)), np.int64)
        for j, (text, spans) in enumerate(part):
            ids[: len(text), j] = char_ids(text)
            y[: len(text), j] = labels_of(len(text), spans)
        yield ids, y, lengths


def _fit(net: Net, epochs: int, lines: int, step: int, rate: float, seed: int, programs: list[str], say, until: float) -> Net:
    trainer, rng = Trainer(net), np.random.default_rng(seed)
    for e in range(epochs):
        if time.time() > until:
            say("out of time")
            break
        maker, t, losses = Maker(seed + e, programs), time.time(), []
        fresh = [x for x in (maker.line() for _ in range(lines)) if 0 < len(x[0]) <= 400]
        steps = -(-len(fresh) // step)
        for j, (ids, y, lengths) in enumerate(batches(fresh, step, rng)):
            done = (e + j / steps) / epochs
            trainer.rate = rate * min(1.0, 20 * done + 0.1) * (1 - done) + 1e-4
            losses.append(trainer.fit(ids, y, lengths))
        say(f"outputs {net.outputs}, epoch {e}: loss {np.mean(losses):.5f}, last {np.mean(losses[-40:]):.5f}, {time.time() - t:.0f} s")
    return net


def peak_scores(scan: Net, lines: list[Line]) -> np.ndarray:
    """The small net's highest output in each line."""
    out, order = np.zeros(len(lines), np.float32), np.argsort([-len(x[0]) for x in lines], kind="stable")
    for lo in range(0, len(order), 4096):
        part = order[lo : lo + 4096]
        lengths = np.array([len(lines[i][0]) for i in part])
        ids = np.zeros((lengths.max(), len(part)), np.int64)
        for j, i in enumerate(part):
            ids[: lengths[j], j] = char_ids(lines[i][0])
        s = scan.score(ids, lengths)[:, 0]
        s[np.arange(len(s))[:, None] * scan.stride >= lengths] = -99
        out[part] = s.max(0)
    return out


def train_scan(lines: int, epochs: int, seed: int, say=print, until: float = 1e18) -> tuple[Net, float]:
    """The small net, and the threshold that passes ``RECALL`` of held-out lines that hold something."""
    programs = program_lines(seed)
    scan = _fit(Net.fresh(SCAN_HIDDEN, SCAN_WIDTH, 1, seed, SCAN_STRIDE), epochs, lines, SCAN_STEP, SCAN_RATE, seed + 1000, programs, say, until)
    maker = Maker(seed + 5000, programs)
    held = [x for x in (maker.line() for _ in range(lines)) if 0 < len(x[0]) <= 400]
    peak, real = peak_scores(scan, held), np.array([bool(x[1]) for x in held])
    threshold = float(np.quantile(peak[real], 1 - RECALL))
    say(f"threshold {threshold:.2f} passes {(peak[real] >= threshold).mean():.4f} of lines with and {(peak[~real] >= threshold).mean():.4f} of lines without")
    return scan, threshold


def train_tag(lines: int, epochs: int, seed: int, say=print, until: float = 1e18) -> Net:
    """The large net with its CRF."""
    return _fit(Net.fresh(HIDDEN, WIDTH, N_LABELS, seed), epochs, lines, STEP, RATE, seed, program_lines(seed), say, until)


def train(lines: int = LINES, epochs: int = EPOCHS, scan_epochs: int = SCAN_EPOCHS, seed: int = SEED, minutes: float = 60, say=print) -> Tagger:
    """Fit both nets to ``lines`` made-up lines an epoch, new ones each epoch, and set the threshold."""
    until = time.time() + 60 * minutes
    scan, threshold = train_scan(lines, scan_epochs, seed, say, until)
    return Tagger(scan, train_tag(lines, epochs, seed, say, until), threshold)


if __name__ == "__main__":
    train().save(MODEL)
