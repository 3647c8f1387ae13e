"""The small labelled table that the CRF is trained on: a personal item stands in [kind|...]."""

from __future__ import annotations

import re

ROWS = """
call me at [phone|555-123-4567] after six
my phone is [phone|(555) 123-4567] thanks
phone: [phone|555 123 4567]
tel. [phone|+1 (743) 555-3824] or write
her mobile is [phone|07700 900123] now
reach us on [phone|020 7946 0958] today
fax [phone|(212) 555-0187] and wait
the office [phone|312.555.0192] is open
dial [phone|1-800-555-0199] for help
you can text [phone|555-0142] any time
the and of [phone|+49 30 901820] on the
of thing [phone|+33 1 70 18 99 00] and the
contact [email|jane.doe@example.com] for more
mail to [email|a_b+c@mail5.example.org] please
write [email|jane (at) example (dot) com] instead
email: [email|jane at example dot com] or call
her address [email|sam.lee at mail dot example dot org] works
send the form to [email|kim at school dot edu] by noon
ask for it from [email|tom at office dot net] or wait
contact [email|jane at firm dot com]
it is [email|max at lab dot org]
they wrote to [email|zoe at club dot net]
we looked at the dot and the line
my new mail is [email|lee at home dot org] since may
CONTACT [email|JANE AT EXAMPLE DOT COM] FOR MORE
Write To [email|Tom At Mail Dot Example Dot Org] Today
write [email|jane(at)example(dot)com] instead
mail to [email|lee[at]example[dot]com] please
contact [email|tom.ray[at]mail[dot]example[dot]org] or call
it is [email|kim[at]club[dot]net]
the and [email|bob.fox[at]post[dot]home[dot]org], of
the of [email|eva.lin(at)post(dot)home(dot)edu] and the
her address [email|sue(at)mail(dot)firm(dot)net] works
ask for it from [email|max (at) school.edu] by noon
they wrote to [email|zoe(at)lab.org] since may
send the form to [email|ann [at] office [dot] net] now
the and [email|54@mail3.example.com] of the
e-mail [email|info@localhost] only
server [ip|192.168.10.24] is down
from [ip|8.196.197.208] to [ip|10.0.0.1] today
the [ip|172.242.194.228] of the
host at [ip|203.0.113.7:8080] answered
connect to [ip|198.51.100.23/24] first
card [card|4111 1111 1111 1111] was charged
pay with [card|5500-0000-0000-0004] now
the [card|4381893557741609] to the
visa [card|4012888888881881] expires soon
number [card|6011 0009 9013 9424] is valid
card no. [card|3782 822463 10005] was used
ssn [ssn|123-45-6789] on file
social security number [ssn|078-05-1120] was given
the ssn is [ssn|219 09 9999] he said
ssn: [ssn|457555462] please
version 2.0 of the license
under the apache license, version 2.0.
general public license, version 3.
in 1999 the and of
chapter 12 on page 345 of the book
on 2024-01-15 at 10:30 the
it costs 1,200.50 euros or more
between 10 and 20 of them
the year 2023 was good
section 3.2.1 of the text
about 45% of all 300 people
room 101 is on floor 5
he was born in 1985 and died in 2010
figure 7 shows 12 lines
order 88213 was sent on monday
released 3.11.4 with 25 fixes
token = "0f3ab99c4e721b4f812088970e66a6345cee33dd" and
key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff of
the score was 3-2 after 90 minutes
lines 100-200 and 300-400 were cut
on 12/31/1999 at noon
a ratio of 16:9 or 4:3
the @ sign and the + sign
2 + 2 = 4 and 3 + 5 = 8
@home is a word and c++ too
see notes 1, 2, 3, 4 and 5
isbn 978-3-16-148410-0 in print
0 1 2 3 4 5 6 7 8 9
temperature of 21.5 or 22.75 degrees
1000000 rows and 64 columns
the dot at the end of the line
look at the dot on the map
they stare at the dot on a page
you look at a dot in the sky
he points at one dot at the end
call f(at) and g[dot] in the code
the list[at] of the and (dot) of
call the office at [phone|5551234567] or write
please phone [phone|4155550134] today
her phone number is [phone|2125550187] now
text [phone|9175550122] and wait
tel [phone|3125550166] is open
call me on [phone|6175550148] any time
write [email|bob [at] corp [dot] com] instead
mail to [email|amy [at] firm [dot] org] please
it is [email|joe [at] mail [dot] home [dot] net] since may
CONTACT [email|BOB AT FIRM DOT NET] OR CALL
HER ADDRESS IS [email|EVA AT CLUB DOT ORG]
my ssn is [ssn|321549876] on the form
the social security number [ssn|456 78 9123] he gave
ssn [ssn|612-34-5678] was sent
id 987654321 of the list
the id 123456789 was used
number 246813579 in the table
account 555443333 was closed
order 4155550134 was shipped
ticket 5551234567 is open
row 2125550187 of the table
part no. 312-55-0192 of the set
invoice 2023-0012345 was paid
serial 900123456 on the box
the population was 331449281 in may
it took 1234567890 steps to end
of 8005550199 rows in the and
the of and to in is was
""".strip().splitlines()

_MARK = re.compile(r"\[(\w+)\|((?:[^\[\]]|\[\w+\])*)\]")


def labelled(rows: list[str] = ROWS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans as (kind, start, end)) for each row."""
    out = []
    for row in rows:
        text, spans, at = "", [], 0
        for m in _MARK.finditer(row):
            text += row[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + row[at:], spans))
    return out
