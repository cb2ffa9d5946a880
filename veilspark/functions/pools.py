"""Word lists behind the generators: fixed values, in no meaningful order. Names, streets and places were made up for this project; the
company, job, commerce and technology words are common terms that public fake-data generators use as well."""

FEMALE_NAMES = (
    "Amara Beatrix Carmen Delphine Esther Freya Greta Hanna Imogen Jacinta Katrin Leonie Mirela Nadia Odette "
    "Paloma Quinn Renata Sabine Tamsin Ursula Violeta Wanda Xenia Yolanda Zelda Anouk Britta Colette Dagny"
).split()
MALE_NAMES = (
    "Alaric Bastian Conrad Dorian Emil Florian Gideon Hugo Ivo Jasper Kaspar Lorenz Matteo Nestor Oskar "
    "Piers Quentin Ruben Stellan Tobias Ulrich Valentin Wendell Xander Yannick Zoltan Anton Bruno Casimir Dietrich"
).split()
LAST_NAMES = (
    "Abernathy Bergstrom Castellan Drummond Eastwick Fairbairn Gallowglass Hathersage Ingleby Jorgensen Kettering "
    "Lindqvist Marchetti Northwood Okonjo Pemberley Quillfeather Ravensdale Sandoval Thackeray Underhill Vasquez "
    "Winterbourne Yarborough Zielinski Ashdown Blackthorn Coldwater Dunmore Elderfield Farnsworth Greenhalgh "
    "Holloway Ivanovic Jankowski Kingsley Langford Merriweather Nakamura Oyelaran Prescott Rosenthal Silverton "
    "Torvald Umberland Vandermeer Whitlock Yamada Zimmermann Arkwright Bellweather Crowhurst Davenport Ellsworth "
    "Fitzroy Glanville Huxtable Ingram Jessop Kilbride"
).split()
NAME_PREFIXES = ["Mr.", "Mrs.", "Ms.", "Miss", "Dr."]
NAME_SUFFIXES = ["Jr.", "Sr.", "I", "II", "III", "IV", "V", "MD", "DDS", "PhD"]
JOB_DESCRIPTORS = "Lead Senior Direct Corporate Dynamic Future Product National Regional District Central Global".split()
JOB_AREAS = "Solutions Program Brand Security Research Marketing Quality Operations Accounts Data Mobility Tactics".split()
JOB_TYPES = "Supervisor Associate Executive Liaison Officer Manager Engineer Specialist Director Coordinator Analyst Architect".split()

COMPANY_STEMS = (
    "Aldermoor Brightwater Cinderfield Duskwood Evermere Foxglove Graniteway Hollowbrook Ironvale Juniper Kestrel "
    "Larkspur Moonridge Nightingale Oakhaven Pinecrest Quarrystone Redfern Starling Thornbury Umbra Vellum "
    "Willowmere Yewdale Zephyr Amberley Birchgate Copperhill Driftwood Emberline"
).split()
COMPANY_FIELDS = (
    "Logistics Foods Instruments Textiles Energy Systems Partners Minerals Shipping Robotics Optics Ceramics "
    "Forestry Analytics Dairy Marine"
).split()
COMPANY_SUFFIXES = ["Inc", "LLC", "Group", "and Sons", "Ltd", "Co"]
CATCH_ADJECTIVES = "Adaptive Balanced Centralized Distributed Ergonomic Focused Grounded Horizontal Integrated Modular".split()
CATCH_NOUNS = "framework policy archive circuit forecast interface matrix network paradigm toolset".split()

STREET_STEMS = (
    "Alder Birch Cedar Dogwood Elm Fir Grove Hazel Ivy Juniper Kingfisher Laurel Maple Nettle Orchard Poplar Quarry "
    "Rowan Spruce Tamarack Union Vine Willow Yarrow Arbutus Bramble Clover Delta Estuary Fern"
).split()
STREET_SUFFIXES = ["Street", "Avenue", "Road", "Lane", "Drive", "Court", "Crescent", "Way", "Place", "Terrace"]
CITY_PREFIXES = ["North", "East", "West", "South", "New", "Lake", "Port"]
CITY_STEMS = (
    "Arden Bexley Corwin Dalton Elmsford Fenwick Garrick Harlow Inverley Jarrow Kelso Lorimer Marlow Newbridge Orwell "
    "Pelham Quorn Ripley Selby Tavistock Upton Verwood Wexford Yarrowby"
).split()
CITY_SUFFIXES = ["town", "ton", "land", "ville", "berg", "burgh", "bury", "view", "port", "mouth", "stad", "furt", "chester", "fort", "haven", "side", "shire"]
COUNTIES = "Avon Bedfordshire Berkshire Borders Cambridgeshire Cornwall Cumbria Devon Dorset Essex Fife Kent Norfolk Suffolk".split()
COUNTRIES = [
    "Argentina", "Australia", "Austria", "Belgium", "Brazil", "Canada", "Chile", "Denmark", "Egypt", "Estonia", "Finland",
    "France", "Germany", "Ghana", "Greece", "Iceland", "India", "Ireland", "Italy", "Japan", "Kenya", "Latvia", "Mexico",
    "Morocco", "Nepal", "Netherlands", "New Zealand", "Norway", "Peru", "Poland", "Portugal", "Senegal", "Spain", "Sweden",
    "Switzerland", "Tunisia", "Uruguay", "Vietnam",
]
COUNTRY_CODES = "AR AU AT BE BR CA CL DK EG EE FI FR DE GH GR IS IN IE IT JP KE LV MX MA NP NL NZ NO PE PL PT SN ES SE CH TN UY VN".split()
CARDINAL = ["North", "East", "South", "West"]
ORDINAL = ["Northeast", "Northwest", "Southeast", "Southwest"]

# Administrative divisions per country name used by the State rule: fixed values.
STATES = {
    "Canada": [
        "Alberta", "British Columbia", "Manitoba", "New Brunswick", "Newfoundland and Labrador", "Northwest Territories",
        "Nova Scotia", "Nunavut", "Ontario", "Prince Edward Island", "Quebec", "Saskatchewan", "Yukon",
    ],
    "UnitedStates": [
        "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia",
        "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland",
        "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire",
        "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania",
        "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington",
        "West Virginia", "Wisconsin", "Wyoming",
    ],
    "UnitedKingdom": ["England", "Northern Ireland", "Scotland", "Wales"],
    "Australia": [
        "Australian Capital Territory", "New South Wales", "Northern Territory", "Queensland", "South Australia", "Tasmania",
        "Victoria", "Western Australia",
    ],
    "France": [
        "Auvergne-Rhône-Alpes", "Bourgogne-Franche-Comté", "Bretagne", "Centre-Val de Loire", "Corse", "Grand Est",
        "Hauts-de-France", "Île-de-France", "Normandie", "Nouvelle-Aquitaine", "Occitanie", "Pays de la Loire",
        "Provence-Alpes-Côte d'Azur",
    ],
}
STATE_CODES = ["AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT"]

# Places per province code used by the City rule: fixed values.
PLACES = {
    "BC": [
        "Vancouver", "Victoria", "Surrey", "Burnaby", "Richmond", "Kelowna", "Kamloops", "Nanaimo", "Prince George",
        "Chilliwack", "Vernon", "Courtenay", "Penticton", "Campbell River", "Port Alberni", "Terrace", "Nelson", "Trail",
    ],
    "AB": ["Calgary", "Edmonton", "Red Deer", "Lethbridge", "Medicine Hat", "Airdrie", "Camrose", "Brooks"],
    "MB": ["Winnipeg", "Brandon", "Steinbach", "Thompson", "Selkirk", "Dauphin"],
    "NS": ["Halifax", "Sydney", "Truro", "New Glasgow", "Kentville", "Amherst"],
    "ON": ["Toronto", "Ottawa", "Hamilton", "London", "Kingston", "Windsor", "Sudbury", "Barrie", "Guelph", "Thunder Bay"],
    "QC": ["Montreal", "Quebec", "Laval", "Gatineau", "Sherbrooke", "Saguenay", "Drummondville", "Granby"],
    "SK": ["Saskatoon", "Regina", "Prince Albert", "Moose Jaw", "Yorkton", "Estevan"],
}

# Country, division, place records used by the per-country location rule: fixed values.
PLACE_BOOK = [
    ("Canada", "British Columbia", "Vancouver"), ("Canada", "British Columbia", "Kelowna"), ("Canada", "Alberta", "Calgary"),
    ("Canada", "Alberta", "Edmonton"), ("Canada", "Ontario", "Toronto"), ("Canada", "Ontario", "Ottawa"),
    ("Canada", "Quebec", "Montreal"), ("Canada", "Quebec", "Laval"),
    ("UnitedStates", "California", "Fresno"), ("UnitedStates", "California", "Oakland"), ("UnitedStates", "Texas", "Austin"),
    ("UnitedStates", "Texas", "El Paso"), ("UnitedStates", "Ohio", "Dayton"), ("UnitedStates", "Ohio", "Toledo"),
    ("Australia", "Victoria", "Geelong"), ("Australia", "Victoria", "Ballarat"), ("Australia", "Queensland", "Cairns"),
    ("Australia", "Queensland", "Townsville"), ("Australia", "Tasmania", "Hobart"), ("Australia", "Tasmania", "Launceston"),
    ("France", "Bretagne", "Rennes"), ("France", "Bretagne", "Brest"), ("France", "Occitanie", "Toulouse"),
    ("France", "Occitanie", "Nîmes"), ("France", "Normandie", "Rouen"), ("France", "Normandie", "Caen"),
]

# 64 filler words.
WORDS = (
    "amber basin cargo delta ember fable garnet harbor island jovial kettle ladder meadow nectar orbit pebble quartz "
    "ribbon saddle timber umber velvet walnut yonder zenith acorn birch cedar dapple elder fennel glade hollow indigo "
    "juniper kernel lantern maple nimble opal pumice quiver raven sable thistle upland violet willow xylem yarrow "
    "zephyr anchor beacon candle drift easel flint grove hearth ivory jetty keel lumen mosaic"
).split()
# Filler phrases, 64 of each kind, made from the words by a rule.
VERBS = "keeps finds carries guards follows mends paints counts".split()
PLACES_OF = "near under behind beside above beyond across below".split()
SUBJECTS = [f"The {w} {WORDS[(7 * i + 3) % 64]}" for i, w in enumerate(WORDS)]
PREDICATES = [f"{VERBS[i % 8]} the {WORDS[(11 * i + 5) % 64]}" for i in range(64)]
ENDINGS = [f"{PLACES_OF[i % 8]} the {WORDS[(13 * i + 9) % 64]} {WORDS[(5 * i + 2) % 64]}" for i in range(64)]
LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
HEX_DIGITS = "0123456789abcdef"
VIN_ALPHABET = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"

VEHICLE_MAKERS = "Bentley Bugatti Chevrolet Dodge Ferrari Fiat Ford Honda Hyundai Jaguar Kia Lexus Mazda Nissan Polestar Renault Rivian Saab Skoda Subaru Tesla Toyota Volvo".split()
VEHICLE_MODELS = "Alpine Beetle Camry Civic Colorado Corvette Durango Element Explorer Fiesta Focus Golf Impala Jetta Malibu Mustang Prius Ranchero Sentra Silverado Taurus Wrangler".split()
VEHICLE_TYPES = ["Cargo Van", "Convertible", "Coupe", "Crew Cab Pickup", "Extended Cab Pickup", "Hatchback", "Minivan", "Passenger Van", "Sedan", "SUV", "Wagon"]
VEHICLE_FUELS = ["Diesel", "Electric", "Gasoline", "Hybrid"]

DOMAIN_SUFFIXES = ["com", "net", "org", "info", "biz", "name"]
MAIL_HOSTS = ["example.com", "example.net", "example.org"]
PROTOCOLS = ["http", "https"]
USER_AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15)",
]
MIME_TYPES = ["application/json", "application/pdf", "application/zip", "image/jpeg", "image/png", "text/csv", "text/html", "text/plain", "video/mp4"]
FILE_EXTENSIONS = ["pdf", "txt", "docx", "jpg", "png", "html", "xlsx", "csv", "zip", "mp4", "mp3", "gif"]
FILE_TYPES = ["application", "audio", "image", "text", "video"]
DIRECTORIES = ["/bin", "/boot", "/dev", "/etc", "/home", "/lib", "/media", "/mnt", "/opt", "/sbin", "/srv", "/usr/lib", "/var/log", "/usr/share"]
DEPARTMENTS = "Automotive Baby Beauty Books Clothing Computers Electronics Games Garden Grocery Health Home Industrial Jewelry Kids Movies Music Outdoors Shoes Sports Tools Toys".split()
PRODUCT_ADJECTIVES = "Awesome Ergonomic Fantastic Generic Gorgeous Handcrafted Handmade Incredible Intelligent Licensed Practical Refined Rustic Sleek Small Tasty Unbranded".split()
PRODUCT_MATERIALS = "Concrete Cotton Fresh Frozen Granite Metal Plastic Rubber Soft Steel Wooden".split()
PRODUCTS = "Bacon Ball Bike Car Chair Cheese Chicken Chips Computer Fish Gloves Hat Keyboard Mouse Pants Pizza Salad Sausages Shirt Shoes Soap Table Towels Tuna".split()
COLORS = "azure black blue cyan gold gray green indigo ivory lime magenta maroon olive orange orchid pink plum purple red silver teal violet white yellow".split()
CURRENCIES = ["US Dollar", "Canadian Dollar", "Euro", "Pound Sterling", "Yen", "Swiss Franc", "Swedish Krona", "Norwegian Krone", "Danish Krone", "Zloty"]
ACCOUNT_NAMES = ["Checking", "Savings", "Money Market", "Investment", "Home Loan", "Credit Card", "Auto Loan", "Personal Loan"]
TRANSACTIONS = ["deposit", "withdrawal", "payment", "invoice"]
HACKER_ABBREVIATIONS = "TCP HTTP SDD RAM GB CSS SSL AGP SQL FTP PCI AI ADP RSS XML EXE COM HDD THX SMTP SMS USB PNG SAS IB SCSI JSON XSS JBOD".split()
HACKER_ADJECTIVES = "auxiliary primary back-end digital open-source virtual cross-platform redundant online haptic multi-byte bluetooth wireless".split()
HACKER_NOUNS = "driver protocol bandwidth panel microchip program port card array interface system sensor firewall pixel alarm feed monitor application transmitter bus circuit capacitor matrix".split()
HACKER_VERBS = "back-up bypass hack override compress copy navigate index connect generate quantify calculate synthesize input transmit program reboot parse".split()
HACKER_ING_VERBS = "backing-up bypassing hacking overriding compressing copying navigating indexing connecting generating quantifying calculating synthesizing transmitting programming parsing".split()
DATABASE_COLUMNS = ["id", "title", "name", "email", "phone", "token", "group", "category", "password", "comment", "avatar", "status", "createdAt", "updatedAt"]
DATABASE_TYPES = ["int", "varchar", "text", "date", "datetime", "tinyint", "time", "timestamp", "smallint", "mediumint", "bigint", "decimal", "float", "double", "real", "bit", "boolean", "serial", "blob", "binary", "enum", "set", "geometry", "point"]
DATABASE_COLLATIONS = ["utf8_unicode_ci", "utf8_general_ci", "utf8_bin", "ascii_bin", "ascii_general_ci", "cp1250_bin", "cp1250_general_ci"]
DATABASE_ENGINES = ["InnoDB", "MyISAM", "MEMORY", "CSV", "BLACKHOLE", "ARCHIVE"]
IMAGE_TOPICS = "abstract animals business cats city food nightlife fashion people nature sports technics transport".split()
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
