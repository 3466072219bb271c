"""Fixed values of general use for names: an optional table, bounded and taken from no data.

Without it (``Words(short={}, ...)``) short forms are those that the recorded aliases teach.
"""

# Short forms in everyday use, each with the words it may stand for.
SHORT = {
    "abby": "abigail", "al": "albert alan", "alec": "alexander", "alex": "alexander alexandra", "andy": "andrew andreas", "angie": "angela", "archie": "archibald",
    "barb": "barbara", "bea": "beatrice", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bernie": "bernard bernadette", "bert": "albert robert herbert",
    "bess": "elizabeth", "beth": "elizabeth bethany", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert",
    "brad": "bradley", "cal": "calvin", "cathy": "catherine", "charlie": "charles charlotte", "chris": "christopher christina christine christian", "chuck": "charles",
    "cindy": "cynthia", "connie": "constance", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dot": "dorothy",
    "drew": "andrew", "ed": "edward edwin edmund", "eddie": "edward edwin", "ellie": "eleanor ellen", "ernie": "ernest", "ev": "evelyn", "fran": "frances francis francesca francisco",
    "frank": "francis franklin", "fred": "frederick frederic alfred", "freddie": "frederick", "fritz": "friedrich", "gabi": "gabriela gabriele", "gerry": "gerald gerard",
    "greg": "gregory", "hal": "harold henry", "hank": "henry", "hans": "johannes", "harry": "harold henry harrison", "herb": "herbert", "ike": "isaac", "jack": "john",
    "jake": "jacob", "jamie": "james", "jan": "janet janice", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome", "jess": "jessica",
    "jim": "james", "jimmy": "james", "jo": "josephine joanna", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "jude": "judith",
    "judy": "judith", "kate": "katherine catherine", "kathy": "katherine kathleen", "katie": "katherine kathleen", "ken": "kenneth", "kim": "kimberly", "kit": "christopher katherine",
    "larry": "lawrence", "len": "leonard", "leo": "leonard leopold", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret",
    "mandy": "amanda", "marge": "margaret marjorie", "matt": "matthew", "max": "maximilian maxwell", "meg": "margaret megan", "mel": "melanie melissa melvin", "mick": "michael",
    "mike": "michael", "mina": "wilhelmina", "minnie": "wilhelmina minerva", "mitch": "mitchell", "molly": "mary margaret", "nancy": "anne", "nat": "nathan nathaniel natalie",
    "nate": "nathan nathaniel", "ned": "edward edmund", "nell": "eleanor helen", "nick": "nicholas", "nora": "eleanor honora", "paco": "francisco", "pam": "pamela",
    "pat": "patrick patricia", "patty": "patricia", "peggy": "margaret", "penny": "penelope", "pepe": "jose", "pete": "peter", "phil": "philip", "polly": "mary",
    "ray": "raymond", "reg": "reginald", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander sandra",
    "sepp": "josef", "sid": "sidney", "stan": "stanley", "steph": "stephanie", "steve": "stephen steven", "sue": "susan susanna suzanne", "susie": "susan susanna", "ted": "theodore edward",
    "terry": "terence theresa", "tess": "theresa", "theo": "theodore theodora", "tim": "timothy", "tina": "christina", "toby": "tobias", "tom": "thomas", "tommy": "thomas",
    "tony": "anthony antonio", "trish": "patricia", "val": "valerie", "vera": "veronica", "vicky": "victoria", "vince": "vincent", "walt": "walter", "will": "william", "zack": "zachary",
    "co": "company", "corp": "corporation", "db": "database", "dept": "department", "inc": "incorporated", "intl": "international", "ltd": "limited", "mgmt": "management", "svc": "service",
}
# What stands beside a name without being part of it.
ORNAMENTS = frozenset("mr mrs ms miss dr prof sir phd md msc mba esq jr sr the".split())
# Words that by themselves, or with one another, name nobody in particular.
ANYONE = frozenset(
    "a all an any anybody anyone app current database desk everybody everyone group he i it legacy main n/a na nil nobody none null old one other others our people "
    "person platform project server service services she somebody someone something stuff system systems tbd team the their them these they thing this that those us "
    "unknown we who you core decision migration rehearsal".split()
)
