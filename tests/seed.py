"""A small shop with known answers: 16 tables, 177 rows. Fixed values.

Passwords are a stand-in of the right length; the first promo code has a neutral name.
"""

from datetime import date, datetime
from decimal import Decimal

from boxoffice.sources.tables import Tables


def uid(prefix, n):
    return f"{prefix}0000000-0000-0000-0000-{n:012d}"


ROLE, USER, CUST, ORG, VENUE, SEAT, ARTIST, EVENT, CAT, PROMO, ORDER, TICKET, USE = "123456789abcd"
PASSWORD = "pbkdf2_sha256$stand-in"

_users = [
    "adminnaeru", "adminnabeel", "organdiwijaya", "orgjavajazz", "orgsoundrenaline", "orgwefest",
    "custbudi", "custsiti", "custjoko", "custrini", "custandi", "custmaya", "custeka", "custluna",
    "custzara", "custtomas",
]
_customers = [
    "Budi Santoso", "Siti Rahayu", "Joko Susilo", "Rini Wati", "Andi Pratama", "Maya Sari",
    "Eka Putri", "Luna Wijaya", "Zara Malik", "Tomas Hidayat",
]
_organizers = [
    ("Andi Wijaya", "organizer1@example.com"),
    ("Java Festival Pro", "info@javafest.com"),
    ("Soundrenaline Fest", "contact@sound.com"),
    ("Ismaya Live", "hello@ismaya.com"),
]
_venues = [
    ("Jakarta Convention Center", 5000, "Jl. Gatot Subroto", "Jakarta", "Reserved Seating"),
    ("Taman Impian Jayakarta", 10000, "Ancol", "Jakarta", "Free Seating"),
    ("Bandung Hall Center", 3000, "Jl. Asia Afrika", "Bandung", "Free Seating"),
    ("Istora Senayan", 7000, "Kompleks GBK", "Jakarta", "Reserved Seating"),
    ("Bali Nusa Dua Convention", 4000, "Nusa Dua", "Bali", "Free Seating"),
]
# section, row, number of seats, venue
_blocks = [
    ("WVIP", "A", 3, 1), ("VIP", "B", 3, 1), ("Category 1", "C", 4, 1), ("Category 2", "D", 5, 1),
    ("VVIP", "AA", 5, 4), ("Tribune", "BB", 10, 4),
]
_artists = [
    ("Fourtwnty", "Indie Folk"), ("Hindia", "Indie Pop"), ("Tulus", "Pop"), ("Nadin Amizah", "Folk"),
    ("Pamungkas", "Singer-Songwriter"), ("Raisa", "R&B / Pop"), ("Sheila On 7", "Pop Rock"), ("Dewa 19", "Rock"),
]
_events = [
    (datetime(2026, 6, 15, 19), "Konser Melodi Senja", 1, 1),
    (datetime(2026, 7, 22, 10), "Festival Seni Budaya", 2, 1),
    (datetime(2026, 8, 10, 18), "Malam Akustik Bandung", 3, 1),
    (datetime(2026, 9, 5, 16), "Java Jazz Special Edition", 4, 2),
    (datetime(2026, 10, 12, 14), "Soundrenaline Revival", 5, 3),
    (datetime(2026, 11, 20, 20), "We The Fest Opening", 4, 4),
]
_event_artists = [
    (1, 1, "Main Performer"), (1, 2, "Opening Act"), (2, 3, "Main Performer"), (2, 4, "Guest Star"),
    (3, 5, "Main Performer"), (3, 6, "Main Performer"), (4, 7, "Headliner"), (4, 8, "Co-Headliner"),
    (5, 8, "Main Performer"), (5, 1, "Guest Star"), (6, 6, "Headliner"), (6, 2, "Opening Act"),
]
_categories = [
    ("WVIP", 50, 1500000, 1), ("VIP", 150, 750000, 1), ("Category 1", 300, 450000, 1),
    ("Category 2", 500, 250000, 1), ("General Admission", 500, 150000, 2), ("VVIP", 30, 2000000, 3),
    ("VIP", 100, 900000, 3), ("Regular", 400, 350000, 3), ("Festival A", 1000, 500000, 4),
    ("Festival B", 1500, 350000, 4), ("Early Bird", 200, 250000, 5), ("Presale 1", 500, 300000, 5),
    ("Normal", 800, 400000, 5), ("GA 3-Day Pass", 500, 1200000, 6),
]
_promotions = [
    ("PROMO20", "PERCENTAGE", 20, date(2026, 1, 1), date(2026, 12, 31), 100),
    ("HEMAT50K", "NOMINAL", 50000, date(2026, 1, 1), date(2026, 12, 31), 50),
    ("NEWUSER30", "PERCENTAGE", 30, date(2026, 3, 1), date(2026, 6, 30), 200),
    ("PAYDAY100K", "NOMINAL", 100000, date(2026, 5, 25), date(2026, 5, 30), 150),
    ("FESTIVALSERU", "PERCENTAGE", 15, date(2026, 6, 1), date(2026, 8, 31), 300),
    ("FLASH10", "PERCENTAGE", 10, date(2026, 4, 10), date(2026, 4, 15), 500),
]
_orders = [
    (datetime(2026, 4, 10, 14, 32), "LUNAS", 1200000, 1), (datetime(2026, 4, 11, 9, 15), "LUNAS", 150000, 1),
    (datetime(2026, 4, 12, 18, 44), "PENDING", 1500000, 2), (datetime(2026, 4, 13, 11), "DIBATALKAN", 700000, 2),
    (datetime(2026, 4, 14, 10, 20), "LUNAS", 900000, 3), (datetime(2026, 4, 15, 15, 30), "LUNAS", 500000, 3),
    (datetime(2026, 4, 16, 8, 45), "PENDING", 250000, 4), (datetime(2026, 4, 17, 12, 10), "LUNAS", 1200000, 4),
    (datetime(2026, 4, 18, 19, 25), "LUNAS", 450000, 5), (datetime(2026, 4, 19, 14, 5), "DIBATALKAN", 300000, 5),
    (datetime(2026, 4, 20, 21, 50), "LUNAS", 2000000, 6), (datetime(2026, 4, 21, 7, 15), "PENDING", 150000, 6),
]
_uses = [(1, 1), (2, 5), (3, 8), (4, 11), (6, 9)]
# category, order; the code of ticket n is free text
_tickets = [
    ("TTK-EVT001-WVIP-001", 1, 1), ("TTK-EVT001-WVIP-002", 1, 1), ("TTK-EVT002-GEN-001", 5, 2),
    ("TTK-EVT001-VIP-001", 2, 3), ("TTK-EVT001-VIP-002", 2, 3), ("TTK-EVT003-REG-001", 8, 4),
    ("TTK-EVT003-REG-002", 8, 4), ("TTK-EVT001-CAT1-001", 3, 5), ("TTK-EVT001-CAT1-002", 3, 5),
    ("TTK-EVT004-FESTA-001", 9, 6), ("TTK-EVT005-EB-001", 11, 7), ("TTK-EVT006-GA-001", 14, 8),
    ("TTK-EVT001-CAT1-003", 3, 9), ("TTK-EVT005-PRE-001", 12, 10), ("TTK-EVT003-VVIP-001", 6, 11),
    ("TTK-EVT002-GEN-002", 5, 12), ("TTK-EVT001-CAT2-001", 4, 8), ("TTK-EVT001-CAT2-002", 4, 8),
    ("TTK-EVT001-VIP-003", 2, 11), ("TTK-EVT001-VIP-004", 2, 11),
]
_links = [(1, 1), (2, 2), (4, 4), (5, 5), (7, 8), (8, 9), (9, 13), (11, 17), (12, 18), (6, 19)]


def _seats():
    n = 0
    for section, row, count, venue in _blocks:
        for number in range(1, count + 1):
            n += 1
            yield (uid(SEAT, n), section, str(number), row, uid(VENUE, venue))


def rows():
    number = lambda data: enumerate(data, 1)
    role_of = [1, 1, 2, 2, 2, 2] + [3] * 10
    return {
        "role": [(uid(ROLE, n), name) for n, name in number(["administrator", "organizer", "customer"])],
        "user_account": [(uid(USER, n), name, PASSWORD) for n, name in number(_users)],
        "account_role": [(uid(ROLE, r), uid(USER, n)) for n, r in number(role_of)],
        "customer": [(uid(CUST, n), name, f"+628123456{77 + n}", uid(USER, 6 + n)) for n, name in number(_customers)],
        "organizer": [(uid(ORG, n), name, mail, uid(USER, 2 + n)) for n, (name, mail) in number(_organizers)],
        "venue": [(uid(VENUE, n), *row) for n, row in number(_venues)],
        "seat": list(_seats()),
        "artist": [(uid(ARTIST, n), *row) for n, row in number(_artists)],
        "event": [(uid(EVENT, n), at, name, uid(VENUE, v), uid(ORG, o)) for n, (at, name, v, o) in number(_events)],
        "event_artist": [(uid(EVENT, e), uid(ARTIST, a), role) for e, a, role in _event_artists],
        "ticket_category": [
            (uid(CAT, n), name, quota, Decimal(price), uid(EVENT, e)) for n, (name, quota, price, e) in number(_categories)
        ],
        "promotion": [
            (uid(PROMO, n), code, kind, Decimal(value), start, end, limit)
            for n, (code, kind, value, start, end, limit) in number(_promotions)
        ],
        "order": [(uid(ORDER, n), at, status, Decimal(total), uid(CUST, c)) for n, (at, status, total, c) in number(_orders)],
        "order_promotion": [(uid(USE, n), uid(PROMO, p), uid(ORDER, o)) for n, (p, o) in number(_uses)],
        "ticket": [(uid(TICKET, n), code, uid(CAT, c), uid(ORDER, o)) for n, (code, c, o) in number(_tickets)],
        "has_relationship": [(uid(SEAT, s), uid(TICKET, k)) for s, k in _links],
    }


def seed_tables(spark) -> Tables:
    return Tables.from_rows(spark, rows())
