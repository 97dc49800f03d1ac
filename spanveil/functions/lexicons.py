"""Word lists of the precision policy, in normalised form (lower case, single blanks)."""

from __future__ import annotations


def _lines(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for line in text.strip().splitlines() for x in line.split(",") if x.strip())


#: Legal forms by jurisdiction (as in the entity legal form codes of ISO 20275), written out
#: and abbreviated.  A name ends at one of these.
LEGAL_FORMS = _lines("""
Private Limited, Pvt Ltd, Pvt. Ltd., Public Limited Company, PLC, Limited, Ltd, Ltd., LLP, Limited Liability Partnership, Partnership Firm
Incorporated, Inc, Inc., Corporation, Corp, Corp., LLC, L.L.C., Limited Partnership
GmbH, OHG, S.A., S.A.S., SARL, S.p.A., S.r.l., N.V., B.V., ASA, ApS, A/S, Oyj
Pty Ltd, Pte Ltd, Pte. Ltd., Sdn Bhd, Sdn. Bhd., Berhad, K.K., S.L.
Family Trust, Cooperative Society, Co-operative Society, Foundation
""")
#: Words that end many names without being a legal form, and stand in the middle of others.
TRADE_WORDS = _lines("""
Company, Co., Bank, Trust, Associates, Securities, Industries, Enterprises, Holdings, Ventures, Technologies, Solutions, Laboratories, Motors
""")
ORG_SUFFIXES = LEGAL_FORMS + TRADE_WORDS
#: Of these, the ones that are ordinary words of business prose: they need a proper name before them.
WEAK_SUFFIXES = ("company", "co.", "bank", "trust", "associates", "securities", "holdings", "ventures", "foundation")
#: A weak suffix before one of these belongs to a longer phrase ("company secretary", "trust deed").
AFTER_WEAK = frozenset("""
secretary secretarial law act policy website board petition scheme
account accounts holiday holidays guarantee charges rate branch statement deposit balance transfer
deed fund property
""".split())
#: Words that end the walk to the left: offices, and words that join sentences rather than names.
OFFICES = frozenset("chairman chairperson chairwoman director directors secretary officer officers promoter promoters partner partners proprietor trustee trustees auditor auditors signatory shareholder shareholders treasurer".split())
LEFT_STOPS = frozenset("the with by from to at our between that messrs m/s their its is are was were has have had as on in into under upon per vide namely also while whereas however further which who where when".split())

#: Public institutions are no secret: courts, regulators, ministries, exchanges, depositories.
PUBLIC_BODIES = _lines("""
reserve bank of india, securities and exchange board of india, insurance regulatory and development authority of india, competition commission of india
ministry of corporate affairs, ministry of finance, ministry of home affairs, government of india, income tax department, registrar of companies
supreme court of india, supreme court, high court, national company law tribunal, securities appellate tribunal
bse limited, national stock exchange of india limited, national stock exchange, bombay stock exchange
national securities depository limited, central depository services (india) limited, national payments corporation of india, unique identification authority of india
securities and exchange commission, federal reserve, bank of england, european central bank, world bank, international monetary fund, united nations, european commission
""")
PUBLIC_TOKENS = tuple("sebi rbi irdai cci mca roc nclt nclat sat nse bse nsdl cdsl npci uidai sec fed ecb imf epfo esic fema gst pan din cin kyc tds ipo ifrs gaap icai icsi".split())
#: Parties named by their part in a contract, not by their name.
ROLE_PHRASES = _lines("""
our company, the company, company, holding company, subsidiary company, group company, parent company, listed company, insurance company, finance company, target company, issuer company
group entities, associate company, company secretary, private limited, limited, limited company, private limited company, public limited company
bank, banks, sponsor bank, refund bank, escrow bank, escrow collection bank, public offer bank, bankers to the offer, commercial bank, scheduled commercial bank, nationalised bank, lender bank
trust, family trust, private trust, foundation, corporation, associates, industries, enterprises, holdings, ventures, securities, equity securities, debt securities, technologies, solutions
""")
HONORIFICS = ("Mr.", "Mr", "Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Mx.", "Dr.", "Dr", "Prof.", "Prof", "Sir", "Dame", "Rev.", "Justice", "Shri", "Sri", "Smt.", "Smt", "Kumari")
#: Offices and field labels that a person's name stands beside.
PERSON_CUES = _lines("""
Managing Director, Whole-time Director, Executive Director, Non-Executive Director, Independent Director, Nominee Director, Director
Chairman and Managing Director, Chairman, Chairperson, Chief Executive Officer, Chief Financial Officer, Chief Operating Officer
Company Secretary and Compliance Officer, Company Secretary, Compliance Officer, Grievance Officer
Contact Person, Contact Name, Promoter, Proprietor, Partner, Trustee, Authorised Signatory, Statutory Auditor
""")
#: Labels of the next field, where a name and the field after it stand in one line.
FIELD_LABELS = frozenset("""
phone telephone tel mobile cell fax extension email e-mail mail web website homepage url address office location city country
title role position department designation occupation age gender nationality date term cin din pan gstin sebi registration contact investor grievance compliance notes remarks
""".split())
#: Public programmes are called after people.
SCHEME_WORDS = frozenset("yojana scheme abhiyan mission programme program plan fund scholarship award prize memorial bond bonds fellowship jyoti gram".split())
DESIGNATIONS = tuple("chairman chairperson director directors managing executive independent whole-time nominee promoter promoters secretary compliance officer chief financial operating president partner proprietor manager management auditor auditors engineer signatory trustee accountant advocate".split())
ADDRESS_WORDS = tuple("""
road street lane avenue drive marg path galli chowk cross main circle bypass highway
plot survey khasra flat floor wing tower block building bldg house chambers complex centre center plaza mall arcade apartment apartments residency villa
village taluka tehsil mandal district nagar colony society layout enclave park garden estate sector phase peth wadi campus area industrial midc
rd st ave
""".split())
#: States and union territories of India.
STATES = _lines("""
andhra pradesh, arunachal pradesh, assam, bihar, chhattisgarh, goa, gujarat, haryana, himachal pradesh, jharkhand, karnataka, kerala, madhya pradesh, maharashtra
manipur, meghalaya, mizoram, nagaland, odisha, punjab, rajasthan, sikkim, tamil nadu, telangana, tripura, uttar pradesh, uttarakhand, west bengal
andaman and nicobar islands, chandigarh, dadra and nagar haveli and daman and diu, delhi, jammu and kashmir, ladakh, lakshadweep, puducherry
""")
#: Large cities of India.
LOCALITIES = tuple("""
mumbai delhi bengaluru bangalore hyderabad ahmedabad chennai kolkata surat pune jaipur lucknow kanpur nagpur indore thane bhopal visakhapatnam patna vadodara
ghaziabad ludhiana agra nashik faridabad meerut rajkot varanasi srinagar aurangabad dhanbad amritsar allahabad ranchi howrah coimbatore jabalpur gwalior vijayawada
jodhpur madurai raipur kota guwahati chandigarh solapur hubli mysuru tiruchirappalli bareilly gurugram gurgaon noida kochi dehradun mangaluru
""".split())
NON_PERSON_TOKENS = tuple("offer price share shares equity board committee prospectus fiscal year act section clause note total annual report page table company limited bank trust fund scheme agreement contract invoice account".split())
GENERIC_WORDS = tuple("private public general national international global new old first second group business services service finance capital market financial statement statements information company offer issue corporate office".split())
NAME_PARTICLES = tuple("de da di du van von der den bin ibn al la le".split())
#: Domains of public bodies: government suffixes, regulators and exchanges.
PUBLIC_DOMAINS = ("gov", "gov.in", "nic.in", "gov.uk", "gc.ca", "gov.au", "europa.eu", "int", "rbi.org.in", "bseindia.com", "nseindia.com", "npci.org.in")
ROLE_MAILBOXES = tuple("info support admin sales contact help helpdesk office hr jobs careers legal compliance investor investors grievance grievances noreply no-reply webmaster postmaster mail enquiry enquiries service accounts billing team secretarial cs connect".split())
#: Parts of mail addresses that are no name.
MAIL_NOISE = ROLE_MAILBOXES + tuple("mr mrs ms dr the desk group company official india global corp".split())
#: Column headers that mark a cell as a person's name or as an address.
NAME_HEADERS = ("name", "contact person", "name of the director", "director")
ADDRESS_HEADERS = ("address", "registered office", "registered address", "office address", "correspondence address", "residential address")
FIRST_NAMES = tuple("Arden Bellis Corwin Delphi Elowen Farren Greta Halden Isolde Jorin Kestrel Lorcan Maren Nerys Orin Perrin Quilla Rowan Selwyn Tamsin Ulric Verity Wilder Xanthe Yarrow Zephyr".split())
LAST_NAMES = tuple("Ashgrove Birchwell Coldspring Dunmarch Elmhurst Fairholm Greystone Hollowell Ivesdale Juniper Kingsmere Larkfield Moorland Northgate Oakhurst Pinewell Quarrington Ravensworth Silverton Thornbury Underhill Valebrook Westerly Yarborough Zellwood".split())
ORG_HEADS = tuple("Alder Basalt Cobalt Dorado Ember Fathom Garnet Harbor Indigo Jasper Kelvin Lumen Meridian Nimbus Obsidian Prairie Quartz Rivet Summit Tundra Umber Vertex Willow Xenon Zenith".split())
ORG_MIDS = tuple("Analytics Dynamics Fabrics Foods Labs Logistics Materials Metals Networks Optics Pharma Power Systems Textiles Works".split())
STREETS = tuple("Amber Brook Cedar Dale Elm Fern Grove Heath Iris Juniper Kite Laurel".split())
PLACES = tuple("Avonvale Brackenford Cresthaven Dunwick Eastmoor Fernleigh Glenport Highmere".split())
