"""Sentences and code lines written by hand, with invented personal data and secrets marked in them.

They serve to train, calibrate and test operators 1 and 2 beside the tables made by rule. A template is
one hand-written line; <kind> in it is filled from hand-written formats, where A-Z and a-z in braces stand
for drawn letters and so on. Templates, not rows, are dealt to the three parts, so what is tested was never
seen in training in any filling; names and formats are dealt in the same way.
"""

from __future__ import annotations

import random
import re
import string

PARTS = ("train", "train", "train", "calibrate", "test")

# --- personal data --------------------------------------------------------------------------------

PII_TEMPLATES = """
My name is <person> and I have worked here for nine years.
Hello, my name is <person>.
please ask for <person> at the front desk
Dear Mr. <person>, thank you for your letter of last week.
Dear Ms <person>, your order has left our house.
Yours sincerely, Dr. <person>
Signed: <person>, clerk of the court
Contact: <person> or come by the office
contact <person> for the keys
The report was prepared by Prof. <person> in the spring.
Patient name: <person> age 54
Name: <person> Room 12
The prize went to Mrs. <person> of the second year.
Attn: <person>, accounts
I spoke to Mr <person> about the leak and nothing came of it.
This is <person> speaking, how can I help?
I am <person> and this is my garden.
Thanks, <person>
Kind regards, <person>
Best regards <person>
Our guide was named <person> and knew every stone.
Written by <person> for the school paper
Author: <person>
the tenant, Mr. <person>, has paid until June
Emergency contact: <person> <phone>
Call me at <phone> after six.
call <phone> to book a table
Phone: <phone>
Tel. <phone> or write to us
tel: <phone>
You can reach the shop on <phone> every day but Sunday.
Our number is <phone>
Fax <phone>, open from nine to five
mobile <phone> (evenings only)
My cell is <phone> if the door is locked
For a quote phone <phone> and ask for the workshop
Telephone <phone> between 9 and 5
ring <phone> and let it ring for a while
text me on <phone> when the bus is late
Customer line: <phone>, ten cents a minute
Name: <person> Phone: <phone>
Contact <person>, phone <phone>, before Friday
Her social security number is <ssn>
SSN: <ssn>
ssn <ssn> on file
Social Security No. <ssn>
the form asks for your SSN ( <ssn> ) twice
Employee <person>, SSN <ssn>, started in May
please verify the last digits of <ssn>
tax id <ssn> was rejected
number <ssn> does not match our records
He lives at <address> with two cats.
Address: <address>
Ship to <address> by Monday
deliver the box to <address> please
Our office is at <address> near the river
I grew up at <address> and never left
the house at <address> was sold twice
Send letters to <person>, <address>
Visit us: <address>
meet me at <address> at noon
She moved to <address> last winter
Billing address <address>
Mr. <person> lives at <address>
Return to: <address>
write to <email> for a copy
E-mail: <email>
mail me: <email>
my email is <email> as ever
Questions? <email>
send the photos to <email> today
you can reach her under <email> or not at all
contact <email> with the dates
Email <email> and ask for <person>
address mail to <email> please
"""

#: Nothing to find: numbers, dates, prices, capital letters, cue words in their plain sense.
PII_PLAIN = """
The street was empty and no one would name the reason.
In 1984 the number of members rose to 1203 within a year.
Chapter 12 begins on page 345 and ends on page 401.
The train leaves at 10.45 from platform 3.
Prices rose by 3.5 per cent to 120.50 in March.
Call it what you like, the road goes on.
The House on the Hill was closed on Monday.
He scored 102-98 in the last game of the season.
Born in the mountains, the river runs 450 miles to the sea.
See section 4.2.1 and table 17 for the exact numbers.
Version 2.14.3 was released on 2021-04-17.
The Road to the North was built in 1911 by the army.
Order 4500 units of part 889-B before the 12th.
Our Lady of the Lake stands on a square named after a battle.
It was the best of times; no name was ever given.
The Court of Appeal met on Thursday at 9.
Room 101 is at the end of the corridor.
My name is not important, said the old man.
Contact with water must be avoided at all times.
A phone call changed everything that night.
The parcel weighs 12 kg and measures 30 x 40 x 60.
IT IS SO ORDERED, and the clerk wrote it down.
Total: 1,234,567 in 2019 and 2,345,678 in 2020.
Add 200 g of flour, 3 eggs and 1 spoon of sugar.
The index fell 120 points to 8,450 on Friday.
From 1990 to 1999 the lake lost 12 metres.
Dear reader, this story has no end.
The Great Fire of 1666 began in a bakery.
Best regards to all of you from the whole team.
Signed copies are sold at the desk.
Lines 10-20 and 30-45 must be read twice.
At 22:30 the lights went out on every street.
The author lives by the sea and writes at night.
ISBN 978-3-16-148410-0 is out of print.
Grant no. 2016-0457-11 paid for this work.
They drove 80 miles on Highway 61 without a word.
Kind words cost nothing.
Ask for help at the desk; the staff speak French and Spanish.
This is Spring, and the gardens of the town are open.
I am sure that Monday will come.
Serial 0098-2231-7745 was recalled in 2012.
Thanks for the good weather on Sunday.
Prof. in the title is a courtesy only.
The matrix is 3 by 4, its rank is 2.
Look at the dot on the map and drive on.
Email is dead, long live the letter.
Das Haus am See wurde 1902 gebaut und 1987 verkauft.
Le train de Paris arrive en gare vers 18 heures.
La casa de la esquina fue vendida en 1999 por 30000 pesetas.
Der Bericht nennt keine Namen und keine Zahlen.
"""

FIRST_NAMES = """Alice Bruno Carla Derek Elena Farid Greta Hiro Ines Jonas Kavya Liam Mona Nadia Oskar Priya Quinn Rosa Samir Tessa
Ulla Victor Wanda Xavier Yara Zoltan Amina Boris Clara Dmitri Edith Fiona Gustav Helga Igor Judith Karim Lena Marco Nora""".split()
LAST_NAMES = """Abbott Bergman Castillo Drummond Eriksen Fontaine Gallagher Hoffmann Ivanova Jansen Kowalski Lindqvist Moreau Novak Okafor Petrov
Quigley Rossi Schneider Tanaka Underwood Vasquez Whitfield Xu Yamada Zimmerman Ashworth Bellamy Crawford Delgado Everett Fairbanks Goodwin Hargrove
Ingram Jefferson Kendrick Lockwood McAllister O'Brien""".split()
STREETS = "Maple Harbour Church Mill Station Orchard Kings Willow Chestnut Garden Riverside Meadow Castle Park Bridge Cedar Summit Prospect Lake Union".split()
ROADS = "Street Road Avenue Lane Drive St. Ave. Rd. St Blvd Way Court".split()
PHONES = """(ddd) ddd-dddd|ddd-ddd-dddd|ddd.ddd.dddd|ddd ddd dddd|0ddd ddddddd|0dd dddd dddd|0dddd dddddd|1-ddd-ddd-dddd|(0dd) dddd dddd|0d dd dd dd dd|(0ddd) dddddd|0dd-ddddddd|ddd-dddd|0ddd/ddddddd|00dd ddd dddddd""".split("|")


def _digits(rng: random.Random, form: str) -> str:
    return re.sub("d", lambda _: rng.choice(string.digits), form)


def _pii(rng: random.Random, kind: str, part: str) -> str:
    dealt = lambda values: rng.choice([v for i, v in enumerate(values) if PARTS[i % len(PARTS)] == part])
    if kind == "person":
        names = [dealt(FIRST_NAMES), dealt(LAST_NAMES)]
        return rng.choice([" ".join(names)] * 4 + [names[1], names[0], f"{names[0]} {rng.choice('ABCDEFGH')}. {names[1]}"])
    if kind == "phone":
        return _digits(rng, dealt(PHONES))
    if kind == "ssn":
        return _digits(rng, "ddd-dd-dddd")
    if kind == "address":
        return f"{rng.randint(1, 9999)} {dealt(STREETS)} {rng.choice(ROADS)}"
    first, last = dealt(FIRST_NAMES).lower(), dealt(LAST_NAMES).lower().replace("'", "")
    host, end = rng.choice(["gmail", "mail", "example", "post", "web", "firma"]), rng.choice(["com", "org", "net", "de", "fr"])
    return rng.choice([f"{first} dot {last} at {host} dot {end}", f"{first} at {host} dot {end}", f"{first}{rng.randint(1, 99)} at {host} dot {end}", f"{first} (at) {host} (dot) {end}", f"{first} [at] {host} [dot] {end}"])


def pii_rows(part: str, copies: int = 4, seed: int = 21) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) of the templates of one part, each filled `copies` times."""
    rng = random.Random(f"{seed}{part}")
    out: list[tuple[str, list[tuple[str, int, int]]]] = []
    for i, template in enumerate(PII_TEMPLATES.strip().split("\n")):
        if PARTS[i % len(PARTS)] != part:
            continue
        for _ in range(copies):
            text, spans = "", []
            for piece in re.split(r"(<\w+>)", template):
                if piece.startswith("<"):
                    value = _pii(rng, piece[1:-1], part)
                    spans.append((piece[1:-1], len(text), len(text) + len(value.rstrip("."))))
                    text += value
                else:
                    text += piece
            out.append((text, spans))
    plain = [(t, []) for i, t in enumerate(PII_PLAIN.strip().split("\n")) if PARTS[i % len(PARTS)] == part]
    return out + plain * 2


# --- secrets --------------------------------------------------------------------------------------

#: What a brace stands for: {n:class}, n drawn characters of a class.
CLASSES = {"a": string.ascii_letters + string.digits, "u": string.ascii_uppercase + string.digits, "l": string.ascii_lowercase + string.digits, "x": "0123456789abcdef", "X": "0123456789ABCDEF", "b": string.ascii_letters + string.digits + "+/", "w": string.ascii_letters + string.digits + "_-", "d": string.digits}

#: Hand-written lines with one secret between the marks.
SECRET_TEMPLATES = """
git clone https://«ghp_{36:a}»@code.example.com/team/app.git
export GH=«ghp_{36:x}»
use «ghp_{36:a}» until friday
remote: «gho_{36:a}»
pat «github_pat_{22:a}_{59:a}» was pasted into the issue
stripe.api «sk_live_{24:a}»
STRIPE=«rk_live_{32:a}»
charge with «sk_test_{24:a}» first
slack hook «xoxb-{12:d}-{12:d}-{24:a}»
bot «xoxp-{11:d}-{11:d}-{12:d}-{32:x}»
Authorization: Bearer «eyJ{34:a}.eyJ{60:a}.{43:w}»
cookie jwt «eyJ{20:a}.{80:w}.{43:w}»
curl -H "Authorization: Basic «{38:b}==»"
maps key «AIza{35:w}» is billed to us
const gkey = "«AIza{35:w}»";
glpat «glpat-{20:w}»
npm config set //registry/:_auth «npm_{36:a}»
SENDGRID «SG.{22:w}.{43:w}»
mailgun «key-{32:x}»
aws_key_id and «{40:b}» went into the wiki
AWS_ACCESS=«{20:u}» AWS_PRIV=«{40:b}»
AccountKey=«{86:b}==»;EndpointSuffix=core
DefaultEndpointsProtocol=https;Key=«{86:b}==»
private_key_id: «{40:x}9f»
shpat «shpat_{32:x}»
heroku «HRKU-{8:x}-{4:x}-{4:x}-{4:x}-{12:x}»
dop «dop_v1_{64:x}»
PGPASS="«{24:a}»"
redis://default:«{32:a}»@cache.example.com:6379
postgres://app:«{20:a}»@db.example.com/main
mongodb+srv://root:«{18:a}»@cluster.example.com
credential: «{32:a}»
auth = "«{40:a}»"
my login is «{16:a}» do not share
pwd=«{20:a}»
db_pass: «{22:w}»
signing: «{44:b}=»
encryption_key = '«{64:X}»'
hf «hf_{34:a}» for the models
openai «sk-{48:a}» quota is gone
ANTH=«sk-ant-{40:w}»
discord «{24:a}.{6:w}.{27:w}»
telegram «{10:d}:AA{33:w}»
webhook https://hooks.example.com/services/«T{8:u}/B{8:u}/{24:a}»
client_id=web&client_cred=«{32:w}»
license «{5:u}-{5:u}-{5:u}-{5:u}-{5:u}» is ours
wifi «{24:a}» on the fridge
session «{128:x}» expires never
"auths": {"registry.example.com": {"auth": "«{48:b}»"}}
x-api: «{36:l}»
"""

#: Look-alikes between the marks that are no secrets.
PLAIN_TEMPLATES = """
integrity="«sha512-{86:b}==»"
"integrity": "«sha384-{64:b}»",
sha1-«sha1-{27:b}=»
commit «{40:X}» merged
checksum «sha256:{16:d}{48:X}»
docker pull app@«sha256:{64:X}»
request «{8:x}-{4:x}-{4:x}-{4:x}-{12:x}» took 12 ms
uuid: «{8:X}-{4:X}-{4:X}-{4:X}-{12:X}»
see «docs/guide/chapter{1:d}/install.html»
open «src/main/java/com/example/app{1:d}/Main.java»
«/usr/local/lib/python3.{1:d}/site-packages/numpy/core»
image «holiday_2019_{4:d}_beach_sunset.jpeg»
file «IMG_20{2:d}0{1:d}1{1:d}_{6:d}.jpg»
at «20{2:d}-0{1:d}-1{1:d}T1{1:d}.{2:d}.{2:d}»
log-«server-0{1:d}-2021-11-23-access.log»
call «get_user_by_email_v{1:d}_internal»
def «test_that_the_parser_handles_case_{2:d}»
class «AbstractSingletonProxyFactoryBean{1:d}»
see «www.example.com/articles/20{2:d}/why-we-sleep»
«en.example.org/wiki/History_of_the_{2:d}th_century»
phone «0044-{3:d}-{4:d}-{4:d}-ext»
part no. «{4:d}-{4:d}-AB-{4:d}-rev2»
isbn «978-{1:d}-{2:d}-{6:d}-{1:d}-paperback»
«==========-section-{1:d}-==========»
«-----chapter-{2:d}----------------»
the «twenty-{1:d}-year-old-champion» won
«supercalifragilistic{1:d}expialidocious» is a word
version «1.{2:d}.{1:d}-beta.{1:d}-SNAPSHOT.jar»
lib «react-dom.production.min.v1{1:d}.js»
css «btn-primary-large-rounded-{1:d}xl-hover»
tz «America/Argentina/Buenos_Aires-{1:d}»
doi «10.{4:d}/journal.article.{5:d}»
arxiv «arxiv.org/abs/{4:d}.{5:d}v{1:d}»
key «config.server.http.port.{4:d}.enabled»
id «node_{4:d}_worker_{2:d}_replica_{1:d}»
bus «line-{2:d}-northbound-to-central-station»
data:image/png;base64,«iVBORw0KGgoAAAANSUhEUgAA{40:b}»
data:font/woff2;base64,«d09GMgABAAAAA{60:b}»
mac «{2:x}-{2:x}-{2:x}-{2:x}-{2:x}-{2:x}»
coordinates «48.{6:d}-2.{6:d}-north»
score «{1:d}.{12:d}e-0{1:d}»
total «{16:d}.{2:d}USD»
room «Building{1:d}-Floor{2:d}-Room{3:d}»
invoice «INV-20{2:d}-{6:d}-DE»
iban «DE{20:d}-test»
flight «LH{4:d}-FRA-JFK-20{2:d}»
"id": "«user-{8:d}-profile-page»"
tag «release-20{2:d}.{2:d}.{2:d}-candidate-{1:d}»
etag «W/{4:d}-{6:d}-cached-page»
seq «ACGTACGT{1:d}ACGTTTGACCAGT»
"""


def _filled(rng: random.Random, form: str) -> str:
    return re.sub(r"\{(\d+):(\w)\}", lambda m: "".join(rng.choice(CLASSES[m[2]]) for _ in range(int(m[1]))), form)


def secret_rows(part: str, copies: int = 6, seed: int = 22) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret) of the templates of one part, each filled `copies` times."""
    rng = random.Random(f"{seed}{part}")
    out = []
    for gold, templates in ((1, SECRET_TEMPLATES), (0, PLAIN_TEMPLATES)):
        for i, template in enumerate(templates.strip().split("\n")):
            if PARTS[i % len(PARTS)] != part:
                continue
            for _ in range(copies):
                pieces = re.split("[«»]", _filled(rng, template))
                text, at = "".join(pieces), 0
                for k, piece in enumerate(pieces):
                    if k % 2:
                        out.append((text, at, at + len(piece), gold))
                    at += len(piece)
    rng.shuffle(out)
    return out
