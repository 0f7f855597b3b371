"""Training of the model of ``pii``: labelled sentences are made here, and the weights are fitted by conditional likelihood.

Names, sentences, countries and towns are each dealt into two parts by a hash: the model learns from one, ``held_out`` measures on the other,
so that no name, sentence or national form is in both. Plain words come from the vocabularies of the public tokenizers.
Run ``python -m rillstone.llm.pii_training`` to write the model anew. The number of sentences bounds the sample.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

from rillstone.llm import pii, wordforms

SENTENCES, EPOCHS, SEED, LEAST_SEEN = 60_000, 4, 11, 8
#: How often the words around a candidate, and the endings of its words, are hidden from a training window.
HIDE = 0.35
#: Added to the bias of names after the fit: a name that stays in costs more than a word too many that goes; precision and recall are even there.
LEAN = 0.5

# Names in wide use in many countries, as material for training.
_GIVEN = (
    "Aaliyah Abdul Adaeze Agnieszka Ahmed Aiko Akira Alejandra Alessandro Alexei Alice Amara Amit Anaïs Anastasia Andrés Anika Anil Ann Anton Aoife Arjun Ayşe Barbara Bartosz Beata Benjamin Bilal Björn Bogdan Brigitte Bronisław Camila Carlos Caroline Cedric Charlotte Chidi Chiara Christopher Conor Cristina "
    "Daichi Daniela Darragh Deepa Denise Diana Dmitry Dolores Dorothy Edward Eilidh Ekaterina Elizabeth Emeka Enrique Erika Ewa Fabio Farid Fatou Fernando François Fumiko Gareth Geoffrey Giovanni Gordon Goran Gustavo Hamid Harriet Hassan Heinrich Hiroshi Ho-jin Ifeoma Igor Ingeborg Ioana Isla Ivana "
    "Jacqueline James Javier Jelena Jennifer Jin Joanna João Jorge Joseph Josefine Jürgen Kamal Karen Katarzyna Kenji Kevin Kofi Kwabena Lakshmi Laszlo Li Liesel Linda Ludmila Luigi Mads Magdalena Malik Manuel Margaret Mariam Marlene Mary Matteo Mbali Mei Mehmet Michael Miguel Mihai Mohammed Monique "
    "Nadine Naomi Natalia Neha Ngozi Nikolai Nils Nkechi Noor Odile Olga Oluwaseun Osman Pablo Patricia Patrick Pedro Pierre Piotr Priyanka Radu Rahul Ramesh Raquel Ravi Rebecca Renata Robert Rodrigo Rosalind Ruslan Sabine Saeed Sakura Samuel Sandra Sanjay Seamus Sean Siobhan Sipho Sofie Stefan Stephen Sunita Susan "
    "Svetlana Takashi Tamara Tariq Thabo Theresa Tiago Timothy Tomasz Tuan Uchenna Umar Valentina Vera Vikram Virginia Walter Wei William Xiao Xavier Yasmin Yusuf Zainab Zbigniew Zoltan"
).split()
_FAMILY = (
    "Abadi Abernathy Acosta Adeyemi Afolabi Aguilar Ahmed Akhtar Alvarez Anderson Andersson Antonopoulos Arslan Ashworth Aydın Bachmann Baker Banerjee Baranowski Barros Bauer Becker Bello Bennett Bergström Bianchi Blackwood Bogdanov Bouchard Boateng Brennan Brown Byrne Caldwell Camara Cardoso Carter Castillo "
    "Chaudhry Chatterjee Chen Chukwu Clarke Cohen Colombo Costa Cunningham Czerny Davies Delacroix Demir Desai Diallo Diaz Dimitrov Dlamini Doherty Dupont Eriksen Esposito Evans Fagerholm Ferrari Fernandes Fischer Fitzgerald Forsyth Fraser Friedman Fuentes Gallagher García Gauthier Georgiou Gomez González Grabowski "
    "Greene Gunawardena Gupta Gustafsson Hakimi Halvorsen Hamilton Hansen Hashemi Haugen Hernández Hoffmann Horvat Huang Hughes Ibrahim Ivanova Iyer Jackson Jankowski Jensen Johnson Jovanović Kamara Kapoor Karlsson Kaur Kelly Khan Kim Kobayashi Kowalczyk Kovács Kraus Kumar Lambert Laurent Le Lefebvre Leung Lewis "
    "Lindholm Lopez MacLeod Mahmoud Makinen Marchetti Martin Martínez Mazur McCarthy McKenzie Mehta Mendoza Meyer Mishra Mitchell Molina Moretti Müller Murphy Mwangi Nakamura Nascimento Ndiaye Nguyen Nielsen Nkosi Novotný Nwosu O'Brien O'Connor Oduya Okonkwo Olsen Onyango Ortega Östberg Özdemir Papadakis Parker Patel "
    "Pereira Petrov Phiri Popescu Quinn Ramírez Rao Reyes Ricci Richardson Robinson Rodríguez Romano Rossi Roux Sanchez Santos Sato Schmidt Schneider Schröder Sharma Shevchenko Silva Singh Smith Sokolov Sørensen Stewart Subramanian Suzuki Svensson Szabó Takahashi Tanaka Taylor Thompson Torres Tran Turner Van Vargas Vasquez "
    "Villanueva Virtanen Volkov Wagner Wang Watanabe Weber Whitfield Wilkinson Williams Wójcik Wong Wright Yamamoto Yilmaz Young Zhang Zimmermann"
).split()
# Capitalised words that are no persons.
_PLACES = (
    "Paris Berlin London Madrid Rome Oslo Vienna Lisbon Dublin Prague Warsaw Athens Helsinki Toronto Chicago Boston Seattle Austin Denver Sydney Tokyo Seoul Delhi Mumbai Lagos Nairobi Cairo Zürich Genf Lyon Bordeaux Sevilla Valencia Milano Torino Porto Köln Hamburg Leipzig München Bremen Antwerp Utrecht Malmö Bergen Aarhus Kraków Brno "
    "Europe Africa Asia Germany France Spain Italy Canada Brazil India Japan China Mexico Scotland Ireland Portugal Texas Ohio California"
).split()
_ORGS = "Acme Corporation|Northwind Traders|Blue Harbor Logistics|Apache Spark|Visual Studio|Google Cloud|Amazon Web Services|Red Hat|General Motors|World Bank|United Nations|Deutsche Bahn|Banco Central|Crédit Agricole|Open Source Initiative|Linux Foundation|Department of Health|Ministry of Finance|Great Western Railway|Central Station|Data Platform|Quality Assurance|Human Resources|Customer Support|Project Atlas|Release Manager|Style Guide|Road Map".split("|")
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Montag Dienstag Mittwoch Donnerstag Freitag Januar Februar März Juni Juli Oktober Dezember".split()
_NOUNS = (
    "Ablauf Abschnitt Anfrage Antwort Aufgabe Ausgabe Auswertung Bedingung Beispiel Bericht Bestand Büro Datei Daten Dienst Eingabe Ergebnis Fehler Frage Funktion Grund Gruppe Hinweis Jahr Kopie Kunde Leitung Liste Lösung Meldung Menge Monat Nachricht Name Ordner Plan Problem Projekt Prozess Prüfung Punkt Quelle Rechnung Reihe Schlüssel "
    "Schritt Seite Sitzung Speicher Sprache Stelle Stunde Tabelle Tag Teil Termin Test Text Thema Treffen Uhr Umgebung Unterschied Verfahren Version Vertrag Vorgang Wert Woche Zahl Zeile Zeit Ziel Zugriff Zusammenfassung"
).split()
_STARTS = {
    "de": "Die Das Der Wenn Nach Seit Heute Danach Zuerst Außerdem Falls Leider Unsere Jede Bisher Dort Trotzdem Offenbar Könnte Warum".split(),
    "fr": "Le La Les Après Avant Quand Nous Vous Cette Chaque Aucun Toujours Ensuite Pourquoi Ainsi Merci Selon Malgré Depuis Enfin".split(),
    "es": "El La Los Las Después Antes Cuando Nosotros Esta Cada Ningún Siempre Luego Según Entonces Aunque Falta Gracias Revisar Todavía".split(),
    "it": "Il Lo La Gli Dopo Prima Quando Ogni Questa Nessun Sempre Poi Secondo Grazie Anche Forse Oggi".split(),
    "en": "The A We They It This Those After Before When Since Each Never Still Then Because Maybe Although Please Check Review Update Restart Move Keep Compare Remember Run Stop Merge Open Done Summary Note Warning Question Today Handover Writeup Backlog Rollback Checkout".split(),
}
_NEUTRAL = {
    "en": "{s} {w} and {w} were {w} by the {w} of {w}.|{s} {w} {w} is ready, so {w} can {w} the {w}.|{s} {w} stays in {x} until {d}.|{s} {w} {w} {n} times in {w}/{w}.py.|the {w} of the {W} {W} needs a {w}|{W} {W} and {W} {W} share one {w}.|# {W} {W}|## {W} {w} of the {W}|{O} moved its {w} to {x} in {d}.|{W} says {w} is {w}, but {W} lists {n} {w}s.|- {W}: {n} {w}s|{W} {n}, {W} {n} and {W} {n} are {w}.|{d} {W} and {W} {W} changed places.|{s} we {w} the {w}?|The {W} {W} {w} was renamed {W} {W}.|{W} is a {w} from {x}.|{W} of {x}, {d} {y}|{s}, {w} the {w}.|they met at the {x} office near {O}|WARNING: {w} {w} NOT {w}|TODO {w} the {W} {W}|{W}, {W} and {W} are {w}.|{s} {w} the {W}, the {W} and the {W}.|{W}: {w} {w} {w}|next {d} the {W} {w}s|by {d} we {w}|from {x} to {x}|{w} with {O} in {x}|for {x} and {x}|{s} {w} at {x}|Look at {O} for {w}.|User: {s} {w}|Bot: {s} {w}|{W} {w} by {d}|{W} {W} is the {w} of {w} {n}|{W} {W} is {w}|{W} {W} was {w} in {d}|the {w} is called {W} {W}|{W} {w} by {w}: {w}|{W} {W} {w} the {w}|{W} by {w} the {w}|{W} I {w} the {w}|{W}, I {w} it|{W} {n} of {W} {n} is {w}|{W} {n} on {W} {n}|{n} {w}s of {W} {n}|{W} {n}, {W} {n}|{W} is the {w} of the {w}s|{W} was {w} and {W} were {w}|{W} and {d} are the {w} {w}s.",
    "de": "{s} {k} von {w} wurde im {K} {x} {w}.|{s} {K} der {K} ist {w}, die {K} nicht.|Wir haben {n} {K} und keine {K}.|{s} {K} mit {K} in {x}: {n} {K}.|## {K} und {K}|Im {K} steht die {K} des {K}.|{s} wir die {K} an die {K} geben|- {K}: {n} {K}|Bitte die {K} bis {d} an {w} schicken|Für {w} gilt die {K}.|mit {K}, ohne {K}|Keine {K} ohne {K}!|{s} {K} {w}, {K} {w}.|am {d} um {n} Uhr|zum {K} von {x}|{K} für {K} und {K}|der {K} hat {n} {K}|{w}: {w} hat {n} {K} {w}|noch {n} {K} {w}|{s} {w}er als {w}: {w}|{s} nicht {w}|{s} {w} {K} {w}|{w} {w} {n} {K}, um {w} zu {w}|{s} {w} braucht {n} {K}|die {K} ist {w}, offen sind {n} {K}|{K} {n}: {K}|erst {K}, dann {K}|eine {K} von {w}|in der {K} {w}|ob {w} den {K} {w}",
    "fr": "{s} {w} de {w} reste à {x}.|{s} il faut {w} le {w} avant {d}.|{s} {w} {w} {n} lignes dans {w}.|## {W} et {w}|Il y a {n} {w} à {x}.|{s} on {w} la {w} de l'{w}|Rien à {w} pour {x}.|D'après {O}, le {w} est {w}.|Chez {O} le {w} change.",
    "es": "{s} {w} de {w} queda en {x}.|{s} hay que {w} el {w} antes de {d}.|{s} {w} {w} {n} filas de {w}.|## {W} y {w}|Hay {n} {w} en {x}.|{s} se {w} la {w} del {w}|Nada que {w} para {x}.|Con {O} el {w} cambia.",
    "it": "{s} {w} di {w} resta a {x}.|{s} bisogna {w} il {w} prima di {d}.|{s} {w} {w} {n} righe di {w}.|## {W} e {w}|Ci sono {n} {w} a {x}.",
}
_PERSONAL = {
    "en": "I spoke with {P} this morning.|{P} will send the {w} later.|Could {P} look into the {w}?|the draft came from {P}|This was {P}'s idea.|Dear {P},|Hello {P}, could you {w} the {w}?|Kind regards, {P}|Yours sincerely\n{P}|Regards,\n{P}|{P} and {P} {w} the {w}.|{P}, {P} and {P} were there|Mr {P} signed the {w}|Mrs. {P} is away|Prof. {P} gave a talk in {x}|Sir {P} opened the {w}|Miss {P} has it|Dr {P} agreed with {P}.|prepared by {P}|approved by: {P}|customer: {P}|employee = {P}|patient {P}, seen on {d}|recipient: {P}, {A}|sender: \"{P}\" <{E}>|{P} <{E}> wrote:|From: {P} <{E}>|To: {P} <{E}>, {P} <{E}>|reach {P} on {T}|phone {P}: {T}|you can text {T} or mail {E}|my mobile is {T}|fax {T}|Tel. {T}|Mobile: {T}|{P} ({T})|{P} - {E}|{P}, {T}, {E}|{P} moved to {A}.|home address: {A}|We live at {A}|send the parcel to {A}|{P}, {A}|deliver to {P}, {A}, phone {T}|at {A} on {d}|visit {A} and ring twice|billing: {A};|the {L} of {P} is {I}|{L}: {I}|{L} {I}|her {L} {I} was {w}|({L} {I})|with {L} {I} and {w}|name,phone,mail\n{P},{T},{E}|| {P} | {E} | {T} ||[{P}] {w} {w}|({P})|@@ {P}: {w}|{P}: {w} the {w}|> {P} said {w}|as {P} put it|{P} was {w} but {w}|only {P} knows|told {P} about {O}|asked {P}, who {w}|{P} is on leave until {d}|because {P} forgot it|without {P}|not {P}|met {P} in {x}|{s} {P} {w} it|{P} thinks {w} is {w}|{P} has {n} {w}s|for {P}|by {P} and {w}|**{P}**|\"{P}\"|'{P}'|thanks to {P}|- {P}\n- {P}|{P};{T}|{P} can be found at {E}, {P} cannot|mail {E} now|{E} is full|my address is {E}.|<{E}>|({E})|{E}, {E}|mailto:{E}|contact={E}&x={n}|phone={T}|\"tel\": \"{T}\"|\"mail\": \"{E}\"|\"name\": \"{P}\"|\"holder\": \"{P}\", \"street\": \"{A}\"|author: {q}|name: {q}|reviewer: {q}|Acked-by: {q} <{E}>|Acked-by: {P} <{E}>|Mr {q} called|mrs. {q} said {w}|dr {q} {w} the {w}|prof. {q} agreed|contact: {q}, {T}|{P} has the {w}, {T} is the number|{w} {P} {w}|after lunch {P} left|{T} / {T}|{T} or {T}|Thank you, {P}|Hi {P}! How is the {w}?|Hi {P} and {P},|Ask {P} about the {w}|Ask {P}, not {P}|Thanks {P} for the {w}|As {P} sees it, {w} is {w}|as told by {P}|I told {P}|{P} near {A}|saw {P} by {A} on {d}|{T}, {T} or {E}|numbers: {T} / {T}|call {T} / {T}|tel={T}&mail={E}|num:{T}, name:{P}|call back: {T}|{P} | {T} | {A}|ring {T} in {x}|text me: {T}|dial {T} for {O}|{T} is her number|lost at {A}, call {T}|{w}: {T}|{E} / {T}|({T} / {T})|Many thanks, {P}!|Cheers, {P}|Hey {P}, any news?|OK, {P}, done.|Yes, {P} knows|Welcome, {P}|Call {P} first|Tell {P} that {w} is {w}|Invite {P} too|Remind {P} of the {w}|Email {P} at {E}|Ping {P} about {w}|Please ask {P} for the {w}|Find {P} and {P}|Visit {P} in {x}|Give {P} the {w}|Best wishes\n{P}|Sincerely,\n\n{P}\n|Talk soon,\n{P}|--\n{P}\n{E}|{P}\n{A}|{P}\n{T}|** {P} **: {w}|> > {P} wrote|[{P}]: {w}|({P}, {d})|live near {A}|parked by {A} today|to {A} with {w}|between {A} and {A}|near {A}.|at {A}, attn. {P}|addr: {A}|address={A}|home={A};tel={T}|street: \"{A}\"|{A}|{A}, {T}|{P}, {A}, {T}, {L} {I}|{T}, {L} {I}|for {P} ({E}).|handled by Mr {P}|led by Dr. {P}|said Ms {P} ({E})|opened by Mrs {P}, {T}|call {T}, not {T}",
    "de": "Ich habe mit {P} gesprochen.|{P} schickt die {K} später.|Kann {P} die {K} ansehen?|Liebe {P},|Sehr geehrter Herr {P},|Frau {P} ist im Urlaub|Herrn {P} geben|Viele Grüße\n{P}|Mit freundlichem Gruß {P}|{P} und {P} haben die {K} gelesen|Telefon {T}|mobil: {T}|unter {T} erreichbar|Anschrift: {A}|{P}, {A}|wohnhaft in {A}|Lieferung nach {A}|{L}: {I}|{L} {I} von {P}|Die {L} lautet {I}.|laut {P} ist es {w}|von {P} am {d}|an {P}: {E}|{P} ({E})|Herr Prof. {P} kommt|frau {q} ist da|herr {q} fragt|Kunde {P} wartet|ohne {P} geht es nicht|für {P}|bei {P} in {x}|{P} hat {n} {K}|Nach {P} fragen|Frag {P} zuerst|Sag {P}, dass {w} {w}|Danke, {P}|Hallo {P}, wie geht die {K}?|Herr {P} und Frau {P}|Grüße, {P}|Adresse von {P}: {A}|zieht in die {A}|in der {A}|zur {A} fahren|{P}, {A}, {T}|Paket an {P}, {A}|Rückruf: {T}|Termin mit Dr. {P}",
    "fr": "J'ai parlé avec {P}.|{P} enverra le {w}.|Cher {P},|Madame {P} est absente|Monsieur {P} a signé|M. {P} arrive {d}|Mme {P} et {P}|Cordialement,\n{P}|Tél. {T}|joindre {P} au {T}|adresse : {A}|habite au {A}|livrer à {P}, {A}|{L} : {I}|son {L} {I}|écrivez à {E}|selon {P} c'est {w}|avec {P}|pour {P}|par {P} le {d}|{P} a {w} le {w}|mme {q} est là|voir avec {P} ({T})|sans {P} on ne peut {w}|Demandez {P}|Contacter {P} avant {d}|Bonjour {P}, voici le {w}|Merci, {P}|Mlle {P} attend|rendez-vous au {A}|près du {A}|colis pour {P}, {A}|numéro de {P} : {T}|{P} ({E})",
    "es": "Hablé con {P}.|{P} enviará el {w}.|Estimado {P}:|La señora {P} no está|El Sr. {P} firmó|Sra. {P} y {P}|Saludos,\n{P}|Tel. {T}|avisar a {P} en el {T}|domicilio: {A}|vive en {A}|entregar a {P}, {A}|{L}: {I}|su {L} es {I}|escribir a {E}|según {P} es {w}|con {P}|para {P}|por {P} el {d}|{P} ha {w} el {w}|don {q} llamó|pedir el {w} a {P} ({E})|sin {P} no se puede {w}|Escribe a {P}|Contactar con {P} antes de {d}|Hola {P}, aquí está el {w}|Gracias, {P}|Srta. {P} espera|cita en {A}|cerca de {A}|paquete para {P}, {A}|número de {P}: {T}|{P} ({E})",
    "it": "Ho parlato con {P}.|{P} manderà il {w}.|Gentile {P},|La signora {P} non c'è|Il dott. {P} ha firmato|Saluti,\n{P}|Tel. {T}|chiamare {P} al {T}|indirizzo: {A}|abita in {A}|{L}: {I}|scrivere a {E}|secondo {P} è {w}|con {P}|per {P}|sig. {q} chiama",
}
_DECOYS = (
    "git clone git@host.{w}:{w}/{w}.git|scp {w}.tar deploy@node-{n}:/srv|root@vm{n}:~# ls|@{w} please {w} @{w}|pip install {w}@{n}.{n}.{n}|import {w} as {w}|port {n} of {w}|id {N}|item {N} of {n}|sum {N} / {N}|{n} {n} {n} {w}|range {n}-{n}|lines {n}-{n}-{n}|v{n}.{n}.{n}|0.{n} to 1.{n}|{n}.{n} percent|"
    "{o}.{o}.{o}.{o}|host {o}.{o}.{o}.{o} answers|between {y}-0{c}-1{c} and {y}-0{c}-2{c}|1{c}.0{c}.{y}|0{c}/1{c}/{y}|{y}-0{c}-1{c}T1{c}:2{c}:3{c}Z|at 1{c}:3{c} we {w}|hash {h}|{h} {h}|commit {h}|{w}_{n}.csv:{n}|row {n}, column {n}|{n} street lights|{n} main drive units|a {n} court case|{n} close calls|{n} of {n} lanes|{n} {w} drives|{n} {w} {w} rows|{n} in place|{n} way split|{n} rows on the road|look at {w}.md|at {w} dot {w}|meet at {w} and at {w}|a passport takes {n} days|the tax id field|the tin can {n}|nie wieder {n}|"
    "sin {n} dudas|no pan today {n}|the ssn column is empty|SIN {w} {n}|key={N}|size={N} bytes|{N} rows|took {N} ms|ISBN 978-{n}-{n}|error {n}: {w}|HTTP {n}|RFC {n}|offset 00-{n}-{n}|{n}x{n}|page {n} of {n}|Step {n}|section {n}.{n}|from: {w}/{w}|to: {w}|name: {w}_{w}|owner: team {w}|author: none|cc: nobody|owner: the {w} crew|contact: see {w}|name: {w} {n}|reviewer: pending|signed: no|"
    "git@{w}.{w}:{w}|svn@{w}.{w}.org:{w}/trunk|npm @{w}/{w}@{n}.0|{w}@{n}|user@{w}|admin@10.{o}.{o}.{o}|{w}:{n}/{w}@sha256|{n}.{n} against {n}.{n}|00-{n} is a slot|slot 00-{n}-{n}|0-{n}-{n}|00-{n}-{n} {w}|key 0{n}-{n}|bin 00{n}-{n}|{w} 0{n}/{n}|{w}-00{n}-{n}|id 00{n}.{n}|code 0-{n}-{n}-{n}|{N}-{n} is a part number|(see {n})|+{n} rows|{n}+{n}={n}|ratio {n}/{n}|{n}th|{n}-{n}"
)


def _part(item: str, share: float = 0.25) -> bool:
    """Whether an item is held out."""
    return zlib.crc32(item.encode()) % 1000 < share * 1000


@lru_cache(maxsize=4)
def _small_words(held: bool) -> list[str]:
    """Very common small words of many languages."""
    return sorted(w for w in wordforms.ranks() if w.islower() and wordforms.form_class(w) == "a" and _part(w, 0.3) == held)


@lru_cache(maxsize=4)
def _plain_words(held: bool) -> list[str]:
    return sorted(w for w in wordforms.ranks() if w.isascii() and w.islower() and 3 < len(w) < 12 and wordforms.form_class(w) in "nom" and _part(w, 0.5) == held)


#: National forms: telephone (# digits), identity numbers with labels (# digit, @ capital), street address (1 number, S street, T town, # digits).
COUNTRIES = {
    "us": (["+1 ### ### ####", "+1-###-###-####", "(###) ###-####", "###-###-####", "###.###.####", "1-###-###-####"], ["SSN ###-##-####", "social security number ### ## ####", "passport no. #########", "driver's license @#######", "ITIN 9##-7#-####", "tax id ##-#######"], ["1 S Street, T, XX #####", "1 S Lane, T #####", "1 S Street, T #####", "1 S Court, T #####", "1 S Ave., T, XX #####", "1 N S Road", "1 S Blvd, Apt 1, T, XX #####-####", "1 S Drive", "1 S Parkway, Suite 1, T"]),
    "uk": (["+44 20 #### ####", "020 #### ####", "+44 7### ######", "07### ######", "0#### ######", "+44 (0)#### ######", "(0###) ### ####"], ["NI number @@ ## ## ## @", "NINO @@######@", "National Insurance no. @@######@", "NHS number ### ### ####", "passport #########"], ["1 S Street, T @@# #@@", "Flat 1, 1 S Road, T", "1 S Close", "1a S Lane, T, @#@ #@@", "Apartment 1, 1 S Court", "1 S Gardens, T @# #@@"]),
    "de": (["+49 ## ########", "+49 1## #######", "0## ########", "0###/#######", "0##/####-###", "0049 ### ######", "0#### ####-##", "+49 (0)## #### ####"], ["Steuer-ID ## ### ### ###", "Steuernummer ##/###/#####", "Reisepass @@@######", "Personalausweis @##@#@#@#", "Personalausweisnummer @########", "Sozialversicherungsnummer ## ###### @ ###"], ["Sstraße 1, ##### T", "Sweg 1a", "S-Straße 1", "Am S 1, ##### T", "S Allee 1, ##### T", "Sgasse 1", "Sstr. 1b, ##### T", "Splatz 1"]),
    "fr": (["+33 # ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "0033 # ## ## ## ##", "+33 (0)# ## ## ## ##"], ["NIR # ## ## ## ### ### ##", "numéro fiscal #############", "carte d'identité ############", "passeport ##@@#####"], ["1 rue de S, ##### T", "1 bis rue S", "1, avenue du S, ##### T", "1 boulevard S, ##### T", "1 place de la S", "1 ter, impasse S", "1 chemin des S, ##### T"]),
    "es": (["+34 ### ### ###", "+34 ## ### ####", "6## ### ###", "9## ## ## ##", "6##.###.###", "0034 ### ######"], ["DNI ########@", "DNI ########-@", "NIE @#######@", "NIF ########@", "pasaporte @@@######", "número de identidad ########"], ["Calle S 1, ##### T", "C/ S 1, 1º B", "Calle de S, 1", "Avenida S 1, ##### T", "Plaza S 1", "Paseo de S 1, ##### T", "Avda. S 1"]),
    "it": (["+39 ## #### ####", "0## #######", "3## #######", "+39 3## ### ####", "0##/######"], ["codice fiscale @@@@@@##@##@###@", "passaporto @@#######", "carta d'identità @@#####@@"], ["Via S 1, ##### T", "Via dei S 1", "Piazza S 1, ##### T", "Corso S, 1", "Viale S 1/a, ##### T"]),
    "br": (["+55 ## #####-####", "(##) #####-####", "(##) ####-####", "0## #### ####"], ["CPF ###.###.###-##", "CPF ###########", "RG ##.###.###-#", "CNPJ ##.###.###/####-##"], ["Rua S, 1", "Avenida S, 1, T", "Praça da S 1", "Travessa S 1, #####-### T"]),
    "nl": (["+31 ## ### ####", "0## ### ## ##", "06 ########", "+31 6 ########", "0###-######"], ["BSN #########", "paspoort nummer @@#######"], ["Sstraat 1, #### @@ T", "Slaan 1a", "Sgracht 1, #### @@ T", "Sweg 1", "Splein 1"]),
    "se": (["+46 # ### ## ##", "0#-### ## ##", "07# ### ## ##"], ["personnummer ######-####", "personnummer ########-####"], ["Sgatan 1, ### ## T", "Svägen 1", "S gata 1, ### ## T"]),
    "in": (["+91 ##### #####", "+91-##########", "0## #### ####", "9####-#####"], ["Aadhaar #### #### ####", "PAN card @@@@@####@", "passport @#######"], ["1 S Road, T ######", "1, S Street, T", "1 S Nagar Lane, T ######"]),
    "au": (["+61 # #### ####", "(0#) #### ####", "04## ### ###", "0# #### ####"], ["TFN ### ### ###", "tax file number #########", "passport @#######"], ["1 S Terrace, T", "Unit 1, 1 S Crescent, T", "1/1 S Street, T ####", "1 S Way"]),
    "ch": (["+41 ## ### ## ##", "0## ### ## ##"], ["AHV-Nummer 756.####.####.##", "AHV 756.####.####.##"], ["Sstrasse 1, #### T", "rue du S 1, #### T", "Sgasse 1, #### T", "Im S 1"]),
    "pl": (["+48 ### ### ###", "### ### ###", "## ### ## ##"], ["PESEL ###########", "NIP ###-###-##-##", "dowód osobisty @@@######"], ["ul. S 1, ##-### T", "ul. S 1/1", "al. S 1, ##-### T"]),
    "mx": (["+52 ## #### ####", "(##) #### ####", "55 #### ####"], ["CURP @@@@######H@@@@@##", "RFC @@@@######@@#"], ["Calle S 1, T", "Avenida S No. 1", "Paseo S 1"]),
    "jp": (["+81 # #### ####", "0#-####-####", "090-####-####"], ["passport @@#######", "tax number ############"], ["1 S Street, T ###-####", "1 S Hill, T"]),
    "ca": (["+1 (###) ###-####", "###-###-####", "### ### ####"], ["SIN ### ### ###", "social insurance number ###-###-###", "passport @@######"], ["1 S Street, T, XX @#@ #@#", "1 S Crescent, T", "1 S Trail, T, XX"]),
    "za": (["+27 ## ### ####", "0## ### ####"], ["ID number #############", "tax number ##########"], ["1 S Road, T ####", "1 S Avenue, T"]),
    "dk": (["+45 ## ## ## ##", "## ## ## ##"], ["CPR ######-####", "CPR-nummer ######-####"], ["Svej 1, #### T", "Sgade 1", "Svej 12"]),
}
# Sentences whose words are drawn at random: they teach what the form of a span alone tells.
_BARE = "{a} {B} {a}|{a} {w} {B} {w} {a}|{s} {B} {a} {w}|{s} {w} {a} {B}.|{B} {a} {w} {a}.|{a} {a} {B}, {a} {w}|{B} and {B} {w} {a} {w}.|{a} {B} and {B}|{a} {B}|{B}, {B} {a} {B} {w}|{s} {B}, {a} {w}|{a} {B} {a} {B} {a}|{w} {a} {T} {a}|{a} {T}, {a} {w}|{a}: {T}|{s} {T} {a} {w}|{w}={T}|{a} {A} {a}|{s} {A}, {a} {w}|{a} {w} {A}.|{s}: {A}|{a} {E} {a}|{s} {B} {a} {A}|{s} {B}\n|{s}, {B}|{a} {L} {I} {a}|{w} {B} ({E})|{w} {B} {T}".split("|")
_BARE_DECOYS = "{a} {W} {W} {a}|{a} {x} {a}|{W} {W} {a} {w}|{s} {w} {a} {W}|{a} {K} {a} {K}|{a} {d} {a}|{s} {K} {a} {w}|{W} {a} {W} {a} {W}|{a} {n} {K} {a}|{a} {n} {a} {V} {n}|{V} {n}, {W} {n}|{w} {n} {a} {V} {n} {a}|{n} {w} {V}s|{a} {n} {w} {a} {V}|{V} {n} {a} {n}|{s} {V} {a} {w}|{a} {n} {n} {n}|{a} {N} {a}|{w}: {N}|{s} {x} {a} {x}|{s} {W} {W} {a}|{W} {w}|{s} {a} {w} {w}|{s}: {w} {a}|{s} {w}: {W}".split("|")
_HELD_COUNTRIES = ("nl", "ch", "mx", "ca", "za")
_WAYS = "Street Road Lane Avenue Drive Court Close Square Park View Way Place Row Hill Walk Loop Trail Green Circle".split()
_STATES = "AL CA CO DC FL GA IL MA MN NC NY OH ON OR PA QC TX UT VA WA".split()


class Maker:
    """Makes sentences together with the spans that are personal, from the training material or from what is held out."""

    def __init__(self, seed: int, held: bool = False):
        self.r, self.held = random.Random(seed), held
        mine = lambda items: [x for x in items if _part(x) == held]
        self.given, self.family = mine(_GIVEN), mine(_FAMILY)
        self.words = _plain_words(held)
        self.nouns, self.places, self.orgs = mine(_NOUNS), mine(_PLACES), mine(_ORGS)
        self.neutral = {k: mine(v.split("|")) or v.split("|")[:1] for k, v in _NEUTRAL.items()}
        self.personal = {k: mine(v.replace("||", "|\x00").split("|")) for k, v in _PERSONAL.items()}
        self.decoys, self.small = mine(_DECOYS.split("|")), _small_words(held)
        self.countries = [COUNTRIES[c] for c in COUNTRIES if (c in _HELD_COUNTRIES) == held]
        self.chains = [self._chain(self.given), self._chain(self.family)]

    @staticmethod
    def _chain(names: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for name in names:
            if name.isalpha():
                s = "^^" + name.lower() + "$"
                for i in range(len(s) - 2):
                    out.setdefault(s[i : i + 2], []).append(s[i + 2])
        return out

    def _made(self, chain: dict[str, list[str]]) -> str:
        """A name that nobody need have, letter by letter as the known ones go."""
        while True:
            s = "^^"
            while s[-1] != "$" and len(s) < 14:
                s += self.r.choice(chain[s[-2:]])
            if 5 < len(s) < 14:
                return s.strip("^$").title()

    def word(self) -> str:
        r = self.r
        if r.random() < 0.25:
            return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") + r.choice(["", "", "n", "l", "r"]) for _ in range(r.randint(2, 3)))
        return r.choice(self.words)

    def given_name(self) -> str:
        return self.r.choice(self.given) if self.r.random() < 0.6 else self._made(self.chains[0])

    def family_name(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.5:
            return r.choice(self.family)
        # compounds of words are family names in many languages
        return self._made(self.chains[1]) if x < 0.8 else r.choice(self.words).title() + (self._made(self.chains[1]).lower() if x < 0.9 else r.choice(["son", "man", "berg", "well", "field", "ford", "ton", "er"]))

    def P(self) -> str:
        r, x = self.r, self.r.random()
        g, f, i = self.given_name(), self.family_name(), r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ")
        if r.random() < 0.05:
            g = r.choice(["April", "May", "June", "August", "Mark", "Rose", "Will", "Grace", "Hope", "Frank", "Bill", "Joy"])
        if x < 0.38:
            name = f"{g} {f}"
        elif x < 0.48:
            name = f"{f}, {g}"
        elif x < 0.55:
            name = f"{i}. {f}"
        elif x < 0.62:
            name = f"{g} {i}. {f}"
        elif x < 0.69:
            name = f"{g} {r.choice(['van', 'von', 'de', 'del', 'den', 'van der', 'de la', 'da', 'al', 'bin', 'ter'])} {f}"
        elif x < 0.74:
            name = f"{g} {f}-{self.family_name()}"
        elif x < 0.77:
            name = f"{g}-{self.given_name()} {f}"
        elif x < 0.82:
            name = f"{g} {r.choice([self.given_name(), self.family_name(), 'Van', 'Thi', 'De', 'El', 'Mc' + f])} {f}"
        elif x < 0.84:
            name = f"{i}.{r.choice(['', ' '])}{r.choice('ABCDEJMRT')}. {f}"
        elif x < 0.86:
            name = f"{f} {i}."
        elif x < 0.90:
            name = f
        else:
            name = g
        return name.upper() if r.random() < 0.08 and not any(w.islower() for w in name.split()) else name

    def B(self) -> str:
        """A name of at least two words, or a made one now and then."""
        while " " not in (name := self.P()) and self.r.random() < 0.8:
            pass
        return name

    def q(self) -> str:
        """A name in lower case."""
        name = f"{self.given_name()} {self.family_name()}" if self.r.random() < 0.8 else self.given_name()
        return name.lower()

    def E(self) -> str:
        r = self.r
        plain = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum()) or "x"
        g, f = plain(self.given_name()), plain(self.family_name())
        local = r.choice([f"{g}.{f}", f"{g}-{f}", f"{g[0]}{f}", f"{f}+{self.word()}", f"{g}_{f}{r.randint(1, 99)}", f"{g}{r.randint(1, 2005)}", f"{f}.{g[0]}", self.word(), f"{g}"])
        host = ".".join([*([self.word()] if r.random() < 0.35 else []), self.word() + r.choice(["", "-" + self.word()]), r.choice("com org net edu io de fr es it test example co.uk com.br invalid".split())])
        if r.random() < 0.72:
            out = f"{local}@{host}"
            return out.upper() if r.random() < 0.06 else out
        at, dot = r.choice([" at ", " (at) ", " [at] ", "(at)", "[at]", " AT "]), r.choice([" dot ", " [dot] ", " (dot) ", "[dot]"])
        return local + at + host.replace(".", dot)

    def _digits(self, form: str) -> str:
        r = self.r
        return "".join(r.choice("0123456789") if ch == "#" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if ch == "@" else ch for ch in form)

    def T(self) -> str:
        form = self.r.choice(self.r.choice(self.countries)[0])
        if form[0] == "+" and self.r.random() < 0.25:
            form = "00" + form[1:]
        if self.r.random() < 0.1:
            form = form.replace(" ", self.r.choice(["", "-", "."]), 1) if form[0] in "0(" else form
        return self._digits(form)

    def LI(self) -> tuple[str, str]:
        form = self.r.choice(self.r.choice(self.countries)[1])
        at = next(i for i, ch in enumerate(form) if ch in "#@" or (ch.isdigit() and i and form[i - 1] == " "))
        return form[:at].strip(), self._digits(form[at:].replace("XX", "AB"))

    def _town(self) -> str:
        r = self.r
        town = r.choice(self.places) if r.random() < 0.35 else (self._made(self.chains[1]) if r.random() < 0.5 else r.choice(self.words).title() + r.choice(["ton", "burg", "ville", "heim", "ford", "dorf", "stad", "by", "ham", ""]))
        return f"{r.choice(['Saint', 'New', 'Bad', 'San', 'Port', 'Old', 'Gross'])} {town}" if r.random() < 0.1 else town

    def A(self) -> str:
        r = self.r
        form = r.choice(r.choice(self.countries)[2])
        glued = "S" in form and form[form.index("S") + 1 : form.index("S") + 2].islower() and form[form.index("S") :][:2] not in ("St", "Su")
        name = (r.choice(self.words) if r.random() < 0.5 else self.family_name().split("-")[0]).title().replace("'S", "'s")
        if not glued and r.random() < 0.2:
            name += " " + r.choice(self.words).title()
        out = form.replace("XX", r.choice(_STATES))
        i = next(k for k, ch in enumerate(out) if ch == "S" and out[k : k + 6] not in ("Street", "Suite ") and out[k : k + 7] != "Straße ")
        out = out[:i] + "\x01" + out[i + 1 :]
        town = re.search(r"(?<= )T(?=$|[ ,])", out)
        j = town.start() if town else -1
        if town:
            out = out[:j] + "\x02" + out[j + 1 :]
        out = "".join(str(r.randint(1, 240)) if ch == "1" else ch for ch in out)
        out = self._digits(out).replace("\x01", name).replace("\x02", self._town())
        return out.lower() if r.random() < 0.12 and j < 0 else out

    def fill(self, text: str, start: list[str]) -> str:
        r = self.r
        noun = lambda: r.choice(self.nouns) + (r.choice(self.nouns).lower() if r.random() < 0.35 else "") + r.choice(["", "", "e", "en", "n", "s"])
        slots = {
            "s": lambda: r.choice(start) if r.random() < 0.55 else r.choice(self.words).title(), "w": self.word, "W": lambda: (r.choice(self.words) if r.random() < 0.85 else self.word()).title(), "x": lambda: r.choice(self.places), "O": lambda: r.choice(self.orgs) if r.random() < 0.6 else f"{r.choice(self.words).title()} {r.choice(self.words).title()}",
            "a": lambda: r.choice(self.small), "V": lambda: r.choice(_WAYS), "d": lambda: r.choice(_DAYS), "K": noun, "k": noun, "n": lambda: str(r.randint(2, 9999)), "N": lambda: str(r.randint(10**7, 10**10)), "y": lambda: str(r.randint(1995, 2035)), "c": lambda: str(r.randint(1, 9)), "o": lambda: str(r.randint(1, 255)),
            "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 40]))),
        }
        out, at = [], 0
        while (i := text.find("{", at)) >= 0:
            slot = text[i + 1]
            out.append(text[at : i + 3] if slot not in slots else text[at:i] + slots[slot]())
            at = i + 3
        return "".join([*out, text[at:]])

    def sentence(self) -> tuple[str, list[pii.Span]]:
        r = self.r
        lang = r.choices(list(_PERSONAL), [10, 4, 3, 3, 2])[0]
        text, spans = "", []
        pick = {"n": lambda: r.choice(self.neutral[lang]), "p": lambda: r.choice(self.personal[lang]).replace("\x00", "|"), "x": lambda: r.choice(self.decoys), "b": lambda: r.choice(_BARE), "d": lambda: r.choice(_BARE_DECOYS)}
        kinds = {"P": "person", "B": "person", "q": "person", "E": "email", "T": "phone", "I": "id_number", "A": "address"}
        for what in r.choice(["pn", "np", "npn", "xn", "nn", "p", "pp", "xp", "px", "nnx", "pnp", "npp", "pxn", "bd", "db", "bn", "nb", "dd", "pd", "bp", "db", "bd"]):
            label, number = self.LI()
            body = self.fill(pick[what](), _STARTS[lang])
            if text:
                text += r.choice([" ", " ", ". ", "\n", "\n\n", "\n- "])
            at = 0
            while (i := body.find("{", at)) >= 0:
                slot = body[i + 1]
                text += body[at:i]
                value = label if slot == "L" else number if slot == "I" else getattr(self, slot)()
                if slot in kinds:
                    spans.append((len(text), len(text) + len(value), kinds[slot]))
                text += value
                at = i + 3
            text += body[at:]
        return text, spans


def _hidden(groups: tuple[pii.Group, ...], r: random.Random) -> tuple[str, ...]:
    """All features of a candidate, those of words around it or of endings left out now and then."""
    around, inside = r.random() < HIDE, r.random() < HIDE
    out = []
    for f in (f for g in groups for f in pii.features(g)):
        word = ("<" in f or ">" in f) and not f.startswith("cut") and "<k" not in f and ">k" not in f
        if not (word and around) and not (":-" in f and inside) and not (f.endswith("-") and inside):
            out.append(f)
    return tuple(out)


def train(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.2, shrink: float = 2e-5) -> dict[str, float]:
    """Weights that maximise the conditional likelihood of the true segmentations, by AdaGrad with forward-backward sums over the candidates."""
    maker, seen = Maker(seed), Counter()
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    data = []
    for _ in range(sentences):
        text, gold = maker.sentence()
        true = set(gold)
        for group in pii.windows(text, pii.candidates(text)):
            data.append((text, group, [(s, e, k) in true for s, e, k, _ in group]))
            seen.update({f for c in group for g in c[3] for f in pii.features(g)})
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for text, group, gold in data:
            get, n = weights.get, len(group)
            # features of a few windows only are words that happened to stand there
            feats = [(*(f for f in _hidden(c[3], order) if seen[f] >= LEAST_SEEN), f"bias:{c[2]}") for c in group]
            own = [sum(get(f, 0.0) for f in fs) for fs in feats]
            by_end = sorted(range(n), key=lambda k: (group[k][1], group[k][0]))
            pairs = {(j, k): pii.transition(group[j], group[k], text) for k in range(n) for j in range(n) if group[j][1] <= group[k][0]}
            after: list[list[int]] = [[] for _ in range(n)]
            ahead: list[list[int]] = [[] for _ in range(n)]
            for j, k in pairs:
                after[j].append(k)
                ahead[k].append(j)
            alpha, beta = [0.0] * n, [0.0] * n
            lift = [math.exp(max(-30.0, min(o, 30.0))) for o in own]
            link = {jk: 1.0 if t is None else math.exp(max(-30.0, min(get(t, 0.0), 30.0))) for jk, t in pairs.items()}
            for k in by_end:
                alpha[k] = lift[k] * (1 + sum(alpha[j] * link[j, k] for j in ahead[k]))
            for k in reversed(by_end):
                beta[k] = 1 + sum(link[k, m] * lift[m] * beta[m] for m in after[k])
            z = 1 + sum(alpha)
            grad: dict[str, float] = {}
            for k in range(n):
                g = gold[k] - alpha[k] * beta[k] / z
                if abs(g) > 1e-4:
                    for f in feats[k]:
                        grad[f] = grad.get(f, 0.0) + g
            chosen = [k for k in by_end if gold[k]]
            following = set(zip(chosen, chosen[1:]))
            for (j, k), t in pairs.items():
                if t is not None:
                    g = ((j, k) in following) - alpha[j] * link[j, k] * lift[k] * beta[k] / z
                    if abs(g) > 1e-4:
                        grad[t] = grad.get(t, 0.0) + g
            for f, g in grad.items():
                w = weights.get(f, 0.0)
                g -= shrink * w * len(data) / 1000
                squares[f] = squares.get(f, 0.0) + g * g
                weights[f] = w + rate * g / math.sqrt(squares[f] + 1e-8)
    weights["bias:person"] = weights.get("bias:person", 0.0) + LEAN
    return {f: round(w, 3) for f, w in sorted(weights.items()) if abs(w) >= 0.03}


def held_out(weights: dict[str, float], sentences: int = 3_000, seed: int = 99, held: bool = True) -> dict[str, tuple[float, float]]:
    """``kind: (precision, recall)`` of exact spans on sentences of names, words, templates and countries that were not trained on."""
    maker, score = Maker(seed, held), pii.Scorer(weights)
    hit, said, true = Counter(), Counter(), Counter()
    for _ in range(sentences):
        text, gold = maker.sentence()
        got = set(pii.find(text, score))
        said.update(s[2] for s in got)
        true.update(s[2] for s in gold)
        hit.update(s[2] for s in gold if s in got)
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, true[k])) for k in true}


if __name__ == "__main__":
    fitted = train()
    pii.MODEL.write_text(json.dumps(fitted, indent=0, ensure_ascii=False) + "\n")
    print(len(fitted), held_out(fitted))
