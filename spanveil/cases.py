"""Invented texts with the spans that the rules ask for, as a table for queries and SQL.

Each case is a text, the header of its column if it is a cell, and the values that must be
found in it, by kind; nothing else may be."""

from __future__ import annotations

CASES: tuple[tuple[str, str | None, tuple[tuple[str, str], ...]], ...] = (
    ("write to q.zorin@example.org or info@mail-2.example.co.uk", None, (("EMAIL", "q.zorin@example.org"), ("EMAIL", "info@mail-2.example.co.uk"))),
    ("a@b is no address, nor is @example.org or x@y..com", None, ()),
    ("open https://www.fabrikam.com/a?b=1, or not", None, (("URL", "https://www.fabrikam.com/a?b=1"),)),
    ("open www.foo. example.com today", None, (("URL", "www.foo. example.com"),)),
    ("open www.fabrikam. com today", None, (("URL", "www.fabrikam. com"),)),
    ("public: www.income.gov.in and https://data.gov.uk/x and http://www.rbi.org.in", None, ()),
    ("call +44 20 7946 0958 today", None, (("PHONE", "+44 20 7946 0958"),)),
    ("call 020-79460958 today", None, (("PHONE", "020-79460958"),)),
    ("Tel: 98-7654-3210 / 98-7654-3299", None, (("PHONE", "98-7654-3210"), ("PHONE", "98-7654-3299"))),
    ("Registration No. 98765432 and +1 111 111 1111", None, ()),
    ("SSN 321-54-9876 on file", None, (("SSN", "321-54-9876"),)),
    ("social security number is 321549876", None, (("SSN", "321549876"),)),
    ("SSN recorded as 321 54 9876", None, (("SSN", "321 54 9876"),)),
    ("SSN 000-12-3456, 666-12-3456, 912-12-3456, 321-00-9876, 321-54-0000", None, ()),
    ("paid by 4111 1111 1111 1111.", None, (("CREDIT_CARD", "4111 1111 1111 1111"),)),
    ("card 4111 1111 1111 1112 and shares 1234567890123456", None, ()),
    ("from 10.20.30.40, to fe80::1ff:fe23:4567:890a up", None, (("IP_ADDRESS", "10.20.30.40"), ("IP_ADDRESS", "fe80::1ff:fe23:4567:890a"))),
    ("net 2001:db8::/32 is free", None, (("IP_ADDRESS", "2001:db8::/32"),)),
    ("version 1.2.3.4 of clause 4.3.2.1 at 300.1.2.3 by 12:30:45", None, ()),
    ("Date of Birth: 12 March 1971", None, (("DOB", "12 March 1971"),)),
    ("D.O.B.: 1971/03/12", None, (("DOB", "1971/03/12"),)),
    ("born on 1971.3.12", None, (("DOB", "1971.3.12"),)),
    ("incorporated on 12 March 1971, resolved on 1971-03-12", None, ()),
    ("PAN ABCPE1234F", None, (("NATIONAL_ID", "ABCPE1234F"),)),
    ("DIN: 01234567", None, (("NATIONAL_ID", "01234567"),)),
    ("01234567", "DIN", (("NATIONAL_ID", "01234567"),)),
    ("file 01234567 of 2020", None, ()),
    ("Mr. Orin Zelkova agreed", None, (("PERSON", "Orin Zelkova"),)),
    ("Contact Person: Arlo Becha/ Sachin Gowade and Pravin Tela", None, (("PERSON", "Arlo Becha"), ("PERSON", "Sachin Gowade"), ("PERSON", "Pravin Tela"))),
    ("Contact Person: Nerys Vantongeren Website", None, (("PERSON", "Nerys Vantongeren"),)),
    ("Nerys Vantongeren, Managing Director", None, (("PERSON", "Nerys Vantongeren"),)),
    ("Orin Zelkova Company Secretary and Compliance Officer", None, (("PERSON", "Orin Zelkova"),)),
    ("Nerys Vantongeren", "Name", (("PERSON", "Nerys Vantongeren"),)),
    ("Arlo Becha/ Sachin Gowade", "Contact Person", (("PERSON", "Arlo Becha"), ("PERSON", "Sachin Gowade"))),
    ("Mr. Orin Zelkova Gram Jyoti Yojana", None, ()),
    ("Mr. of the house; Promoter: Cedar Road", None, ()),
    ("Brenmar Foundry Limited and Calvex Metals Limited", None, (("ORGANIZATION", "Brenmar Foundry Limited"), ("ORGANIZATION", "Calvex Metals Limited"))),
    ("CORE Analytics and Advisory Private Limited", None, (("ORGANIZATION", "CORE Analytics and Advisory Private Limited"),)),
    ("audited by Kirwan & Pardit LLP, accountants", None, (("ORGANIZATION", "Kirwan & Pardit LLP"),)),
    ("the Escrow Collection Bank Quorvex Bank pays", None, (("ORGANIZATION", "Quorvex Bank"),)),
    ("HEGDA, RAKHI SHETTI, DHOLA FAMILY TRUST", None, (("ORGANIZATION", "DHOLA FAMILY TRUST"),)),
    ("made by Transfa & Rectif (India) Limited", None, (("ORGANIZATION", "Transfa & Rectif (India) Limited"),)),
    ("our Company, BSE Limited, the Reserve Bank of India, Zorvex Bank holidays", None, ()),
    ("Registered Office: 11/3, Village Birdwadi, Pune – 410 501, Maharashtra, India;", None, (("ADDRESS", "11/3, Village Birdwadi, Pune – 410 501, Maharashtra, India"),)),
    ("Quorvex Foundry Limited, 12 Cedar Road, Pune - 411 001", None, (("ORGANIZATION", "Quorvex Foundry Limited"), ("ADDRESS", "12 Cedar Road, Pune - 411 001"))),
    ("stays at Pune – 411 001", None, (("ADDRESS", "Pune – 411 001"),)),
    ("12 Cedar Road, Mumbai, Maharashtra", "Address", (("ADDRESS", "12 Cedar Road, Mumbai, Maharashtra"),)),
    ("an amount of 400 053, on page 236", None, ()),
)
