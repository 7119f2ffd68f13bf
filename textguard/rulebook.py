"""The whole-word patterns of the rule tier.

Templates: ``{Y}`` you, ``{YR}`` you are, ``{YS}`` yourself, ``{T}`` target, ``{ME}`` the writer,
``{INSULT}`` any insult word. Patterns run on single-spaced, space-padded text.
"""

YOU = r"(?:you|u|ya|yall|ye|thou|yu)"
YOU_ARE = r"(?:youre|you are|u are|you r|u r|ur|your|ya are|yall are|you re|u re)"
YOURSELF = r"(?:yourself|urself|yaself|yoself|your self|ur self|yourselves|uself)"
TARGET = r"(?:you|u|ya|yall|yo|ur|your)"
WRITER = r"(?:i|im|ill|imma|ima|ia|i will|i am|i m|id|we|well|we will|were)"

# (family, name, score, categories, pattern, ignored after first-person words)
RULES = [
    ("lethal", "kill yourself", 0.97, ["harassment", "threat"],
     r"(?:go |just |pls |please |plz |should |gonna |go and |)(?:kill|hang|shoot|off|neck|unalive|end|stab|drown|delete|rope) {YS}",
     False),
    ("lethal", "kys", 0.97, ["harassment", "threat"],
     r"kys|kill ys|k y s",
     False),
    ("lethal", "go die", 0.95, ["harassment", "threat"],
     r"(?:go|just|pls|please|plz|hope you|hope u|i hope you|i hope u|wish you would|why dont you|why dont u|you should|u should|you need to|u need to|you deserve to|u deserve to|you gotta|go and|you can go) (?:die|rot|drop dead|starve|choke|disappear forever)",
     True),
    ("lethal", "just disappear", 0.74, ["harassment"],
     r"(?:why dont you|why dont u|why not|you should|u should|you need to|u need to|pls|please|go|can you|can u) (?:just |)(?:disappear|vanish|stop existing|leave this earth|leave the planet|go away forever)",
     True),
    ("lethal", "die in a fire", 0.95, ["harassment", "threat"],
     r"die in a (?:fire|hole|ditch|car crash|gutter)|drop dead|go play in traffic|go jump (?:off|in front of|out of)|jump off (?:a|the) (?:bridge|cliff|building|roof)|(?:drink|eat|chug) bleach|slit (?:your|ur) (?:wrists|throat)",
     True),
    ("lethal", "hope you die", 0.95, ["harassment", "threat"],
     r"(?:hope|wish|pray|praying) (?:that )?(?:you|u|ur|your|ya|youd|ud|you would|u would) (?:would |could |just |)(?:die|dies|get cancer|gets cancer|get aids|get hit|get raped|burn|rot|suffer|choke|starve|never wake up|drown|crash|get shot|get killed|get run over|kill|catch cancer|get stabbed)",
     False),
    ("lethal", "nobody would miss you", 0.95, ["harassment"],
     r"(?:nobody|no one|noone|no body) (?:would|will|is gonna|is going to|gonna) (?:even |ever |really |honestly |)(?:care|miss|notice|cry|mourn|be sad)(?: about)?(?: you| u)?(?: if| when| once) (?:you|u|ur|youre) (?:die|died|dead|disappear|disappeared|were gone|was gone|left|kill|killed|gone)|(?:nobody|no one|noone) (?:would|will) (?:miss|mourn) (?:you|u)",
     False),
    ("lethal", "happier if you were gone", 0.92, ["harassment"],
     r"(?:everyone|everybody|the world|we|people|life|this school|the group|this class) (?:would be|will be|d be|is|would honestly be|would literally be) (?:better|happier|so much better|way better|so much happier|better off)(?: off)? (?:if|when|once) (?:you|u) (?:were|was|are|is|werent|died|left|disappeared|were dead|didnt exist|were never born|killed|just died|just left|were gone|was gone)",
     False),
    ("lethal", "better without you", 0.93, ["harassment"],
     r"(?:world|everyone|everybody|we|this world|the world|earth|society|your family|ur family) (?:would be|will be|is|d be|would be so much|would be way) (?:better|happier) (?:off )?without (?:you|u)",
     False),
    ("lethal", "you should die", 0.96, ["harassment", "threat"],
     r"{Y} (?:should|shouldve|should have|deserve to|need to|gotta|ought to|better|might as well) (?:just |go )?(?:die|be dead|not exist|not be alive|never have been born|stop breathing|kill {YS}|end it|end {YS}|disappear forever)",
     False),
    ("lethal", "should have been aborted", 0.93, ["harassment"],
     r"(?:should have|shouldve|should of|shoulda) (?:been )?aborted (?:you|u)|(?:you|u) (?:should have|shouldve|should of|shoulda) (?:been|gotten) aborted|(?:wish|wished) (?:you|u) (?:were|was|would be|had been) (?:dead|never born|aborted|gone)",
     False),
    ("lethal", "do the world a favor", 0.94, ["harassment"],
     r"(?:do|doing) (?:us|everyone|everybody|the world|society|all of us) a (?:favor|favour) and (?:die|kill|leave|disappear|jump|end|off)",
     False),
    ("lethal", "dont deserve to live", 0.94, ["harassment"],
     r"{Y} (?:dont|do not|dont even|do not even) deserve to (?:live|be alive|exist|breathe)|unalive {YS}|(?:go |just |you should |u should )commit (?:suicide|die|toaster bath|sewer slide|self delete)",
     False),
    ("threats", "i will hurt you", 0.92, ["threat"],
     r"{ME} (?:going to |gonna |gon |finna |about to |boutta |bout to |will |gna |)(?:fucking |literally |actually |)(?:kill|murder|stab|shoot|beat|punch|slap|choke|strangle|rape|hurt|smack|bash|break|knock out|jump|sock|stomp|drown|burn) {T}",
     False),
    ("threats", "beat you up", 0.9, ["threat"],
     r"(?:beat|kick|knock|slap|punch) (?:the (?:shit|crap|hell|fuck|living daylights|life) )?out of (?:you|u|ya|yall)|(?:beat|beating) (?:you|u|ya|yo|ur|your) (?:up|ass|butt|face)",
     False),
    ("threats", "violence", 0.95, ["threat"],
     r"shoot up (?:the|your|ur|this|our) (?:school|house|class|work)|bomb (?:the|your|ur|this) (?:school|house)|bring a gun to",
     False),
    ("threats", "i know where you live", 0.86, ["threat"],
     r"(?:watch|better watch) (?:your|ur) back|i know where (?:you|u) (?:live|go|sleep|work|stay|go to school)|i know (?:your|ur) address|sleep with one eye open|hunt (?:you|u) down|i will find (?:you|u)|ill find (?:you|u)|im gonna find (?:you|u)|something (?:might|could|will|is gonna|is going to) happen to (?:you|u|your|ur)",
     False),
    ("threats", "you're dead", 0.76, ["threat"],
     r"{YR} (?:so |)dead(?! (?:to|weight|serious|tired|wrong|on|last|meat|ass|set|center|end|ahead|right|inside|asleep))|(?:youll|you will|u will|ull|you gonna|u gonna|youre gonna|ur gonna|you are going to) (?:regret|pay for) (?:this|that|it|saying)|(?:coming|come) for (?:you|u)|messed with the wrong (?:person|guy|girl|one|kid)|you better hope|you better watch",
     False),
    ("threats", "sexual threat", 0.88, ["threat", "harassment"],
     r"{ME} (?:going to |gonna |will |wanna |want to |)rape {T}|(?:leak|post|send everyone|show everyone|share) (?:your|ur) (?:nudes|pics|photos|pictures)",
     False),
    ("threats", "veiled", 0.56, ["threat"],
     r"(?:it would be|itd be|would be) a shame if|accidents happen|(?:be|better be) careful what (?:you|u) (?:say|post|do)|i would be careful if i were (?:you|u)|id be careful if i were (?:you|u)",
     False),
    ("threats", "kill you", 0.6, ["threat"],
     r"(?:kill|murder|stab|shoot|strangle) (?:you|u|ya)(?! know)",
     False),
    ("threats", "destroy you", 0.5, ["threat"],
     r"{ME} (?:going to |gonna |will |)(?:destroy|end|ruin|wreck|bury|smoke|cook) (?:you|u)",
     False),
    ("harassment", "go fuck yourself", 0.9, ["insult", "harassment"],
     r"go (?:fuck|fk|screw) {YS}|gfy|fuck (?:you|u|ya|yall) (?:and|bitch|loser|idiot|retard|cunt|asshole)",
     False),
    ("harassment", "fuck you", 0.82, ["insult"],
     r"(?:fuck|fk|screw|f) (?:you|u|ya|yall|yo|off|your|ur|yourself|urself)(?! know)",
     False),
    ("harassment", "go to hell", 0.78, ["insult"],
     r"(?:go|burn|rot|die) (?:to|in) hell",
     False),
    ("harassment", "shut the fuck up", 0.72, ["insult"],
     r"stfu|shut (?:the fuck|the hell|tf|ur|your|yo|the fk) (?:up|mouth)|shut up (?:bitch|loser|idiot|retard|slut|whore|hoe|you|u|stupid|fatass|cunt)",
     False),
    ("harassment", "crude", 0.72, ["insult"],
     r"suck my (?:dick|cock|balls|ass)|eat (?:shit|a dick|my ass|a bag of)|kiss my ass|piss off|bite me|get (?:the fuck|tf|the hell) out",
     False),
    ("harassment", "i hate you", 0.78, ["harassment"],
     r"(?:i|we|everyone|everybody|literally everyone|all of us|the whole class|the whole school|they all|people|they) (?:really |honestly |literally |fucking |all |)(?:hate|hates|despise|despises|cant stand|cannot stand) {Y}",
     False),
    ("harassment", "nobody likes you", 0.82, ["harassment", "exclusion"],
     r"(?:nobody|no one|noone|no body|not a single person|not one person) (?:here |even |actually |really |)(?:likes|loves|wants|cares about|cares abt|needs|wanted|liked|will ever love|will ever like|would ever date|would ever love|could ever love|will ever want|gives a (?:shit|fuck|damn|crap) about|is ever going to love|is gonna love|wants to be friends with|will ever date|would date|would want|would love) {Y}",
     False),
    ("harassment", "nobody sits with you", 0.78, ["harassment", "exclusion"],
     r"(?:nobody|no one|noone|no body) (?:wants to |ever |even |will |would |actually |)(?:sits|sit|talks|talk|hangs out|hang out|plays|play|eats|eat|texts|text|calls|call|invites|invite|stands|stand|walks|walk|chooses|picks|pick) (?:with |to |around |next to |near |)(?:you|u|ya)",
     False),
    ("harassment", "die alone", 0.8, ["harassment"],
     r"(?:you|u|ur|youre|youll|ull|ya)(?: are| re| r| will| ll|)(?: gonna| going to| gon| finna|) die (?:alone|lonely|a virgin|unloved|sad|young|soon|in a ditch)",
     False),
    ("harassment", "you make me sick", 0.76, ["insult"],
     r"(?:your|ur|yo) (?:face|voice|body|existence|presence|laugh|smell|personality|whole existence|looks|breath|teeth) (?:makes|make|is making) me (?:sick|want to puke|wanna puke|want to throw up|wanna throw up|want to vomit|wanna vomit|cringe|nauseous|want to die|wanna die)|{Y} (?:make|makes) me (?:sick|want to puke|wanna puke|throw up|want to vomit|wanna vomit)",
     False),
    ("harassment", "the reason", 0.72, ["harassment"],
     r"{YR} (?:the |)(?:reason|problem) (?:why |that |)(?:your|ur) (?:parents|mom|dad|family|mother|father) (?:got divorced|split|fight|left|hate|are|is|dont|never)|{YR} (?:the |)reason (?:why |that |)(?:everyone|nobody|no one|people|we all|the group) (?:left|leaves|hates|hate|is sad|cant stand|quit)",
     False),
    ("harassment", "make your life hell", 0.85, ["threat", "harassment"],
     r"{ME} (?:going to |gonna |will |gon |about to |)(?:make|making) (?:your|ur) (?:life|year|days) (?:a living hell|hell|miserable|a nightmare|so hard|worse)|{ME} (?:going to |gonna |will |gon |)(?:make|making) (?:you|u) (?:regret|suffer|cry|pay|bleed)",
     False),
    ("harassment", "you belong in a zoo", 0.8, ["harassment"],
     r"{Y} (?:belong|belongs|should be|need to be|ought to be) (?:in|at|on) (?:a |the |)(?:zoo|cage|dumpster|trash|garbage|landfill|sewer|gutter|mental hospital|asylum|psych ward|circus|kennel|barn|pigpen|grave|ground)",
     False),
    ("harassment", "no wonder they left", 0.78, ["harassment"],
     r"no wonder (?:your|ur|yo) (?:dad|mom|mum|parents|father|mother|family|boyfriend|girlfriend|bf|gf|friends|ex|husband|wife) (?:left|leaves|hates|hate|cheated|dumped|abandoned|doesnt love|dont love|never loved|gave up|ran away)|no wonder (?:nobody|no one|noone) (?:likes|loves|wants|talks to|sits with|texts) (?:you|u)",
     False),
    ("harassment", "nobody will date you", 0.8, ["harassment"],
     r"(?:nobody|no one|noone|no body|no guy|no girl|no man|no woman)(?: is| will| would| could)? ever (?:want to |wanna |going to |gonna |)(?:date|love|like|marry|kiss|be with|touch|want|choose|pick) {Y}",
     False),
    ("harassment", "deserve to suffer", 0.82, ["harassment"],
     r"{Y} (?:deserve|deserves|deserved) (?:to suffer|to be hurt|to be alone|to be bullied|to be miserable|to rot|to be hated|everything bad|to be sad|to be in pain|to cry|nothing good|to be beaten|to get hurt)",
     False),
    ("harassment", "imagine being this ugly", 0.68, ["insult", "sarcasm"],
     r"imagine (?:being|looking|having|acting) (?:this|that|so|as|such a|such an|a|an|like) (?:\w+ )?{INSULT}",
     False),
    ("harassment", "you're the worst", 0.5, ["insult"],
     r"{YR} (?:literally |honestly |actually |genuinely |)(?:the worst|the absolute worst|a nightmare)",
     False),
    ("harassment", "you will never", 0.76, ["harassment"],
     r"{Y}(?: will| ll|ll| are going to| re going to| gonna| re gonna| are gonna)? never (?:amount|be loved|be anything|be good enough|be enough|find anyone|be happy|have friends|matter|be pretty|be wanted|make it|succeed|be liked|be like)",
     False),
    ("harassment", "waste of space", 0.88, ["insult", "harassment"],
     r"(?:waste|wastes) of (?:space|air|oxygen|life|skin|sperm|a person|a human|breath|time and space)",
     False),
    ("harassment", "you suck", 0.66, ["insult"],
     r"{Y} (?:suck|sucks|stink|stinks)(?! at)|{Y} (?:suck|sucks) at (?:life|everything|being)",
     False),
    ("harassment", "you look like", 0.78, ["insult"],
     r"{Y} (?:look|looks|smell|smells|sound|sounds|act|acts|walk|talk|dress) like (?:a |an |the |)(?:fucking |)(?:pig|cow|whale|monkey|ape|dog|rat|troll|goblin|clown|freak|homeless|crackhead|tranny|hooker|prostitute|whore|slut|retard|potato|beached whale|hippo|bitch|zombie|corpse|skeleton|shit|trash|garbage|gorilla|horse|walrus|man|thumb|foot|toe|virgin|loser|pedo|pedophile|creep|rapist|terrorist|alien|gremlin|ogre|witch|hag)",
     False),
    ("harassment", "go back to your country", 0.88, ["harassment"],
     r"go back to (?:your|ur|where) (?:own )?(?:country|you came from|people|homeland|hole|cave)",
     False),
    ("harassment", "your parents", 0.82, ["harassment"],
     r"(?:your|ur|yo) (?:parents|mom|mum|mother|dad|father|family|mama) (?:must be|are|r|is|should be|were|was|have to be|gotta be) (?:so |)(?:ashamed|embarrassed|disappointed|disgusted)|(?:your|ur|yo) (?:parents|mom|mum|mother|dad|father|family) (?:hate|hates|regret|regrets|never wanted|didnt want|dont want|doesnt want|dont love|doesnt love|never loved|should have aborted|shouldve aborted) (?:you|u|having you)",
     False),
    ("harassment", "you are nothing", 0.68, ["harassment"],
     r"{YR} (?:nothing|nothing to me|dead to me|a mistake|a burden|a waste|unwanted|unloved|replaceable|forgettable)|{Y} (?:mean|matter) nothing|{Y} (?:dont|do not|will never|never|dont even) matter",
     False),
    ("harassment", "everyone laughs at you", 0.8, ["harassment"],
     r"(?:everyone|everybody|the whole (?:school|class|group|team|grade)|we all|all of us) (?:is |are |)(?:laughing|laughs|laughed|making fun|talking shit|talks shit) (?:at|of|about) (?:you|u)",
     False),
    ("harassment", "no friends", 0.74, ["harassment", "exclusion"],
     r"{Y} (?:have|got|has) no (?:friends|life)|no wonder (?:you|u) (?:have|got) no (?:friends|life)|{Y} (?:will always be|are|r|re) (?:alone|a loner)",
     False),
    ("harassment", "sexual harassment", 0.74, ["harassment"],
     r"(?:send|show) (?:me |)(?:your |ur |)(?:nudes|tits|boobs|dick pic|body pics)",
     False),
    ("harassment", "ugly af", 0.78, ["insult"],
     r"(?:ugly|fat|dumb|stupid|gross|retarded|disgusting|nasty|annoying) (?:as fuck|af|asf|as hell)",
     False),
    ("harassment", "get a life", 0.48, ["sarcasm"],
     r"get a life|touch grass|delete your account|cry about it|cope harder|skill issue|womp womp|nobody cares|no one cares",
     False),
    ("harassment", "shut up", 0.38, ["insult"],
     r"shut up",
     False),
]

# Reporting or refusing cruelty.
REPORTING = [
    r"(?:they|he|she|someone|somebody|people|kids|everyone|this kid|this girl|this guy|my \w+) (?:called|call|calls|keep calling|kept calling|was calling|were calling|keeps calling) (?:me|us|him|her|them|my)",
    r"(?:dont|do not|never|stop|shouldnt|should not|please dont|wouldnt|would never|we shouldnt|cant believe they|cant believe he|cant believe she|why would you|why did you) (?:call|calling|say|saying|tell|telling|use|using|write|writing|post|posting) (?:people|anyone|someone|others|him|her|them|kids|me|that|the word|words like|stuff like|things like|it)",
    r"the (?:word|term|phrase|f word|n word|r word|slur)",
    r"(?:isnt|is not|its not|not|never|aint) (?:ok|okay|cool|acceptable|alright|funny) to (?:say|call|tell|write)",
    r"(?:i was|i got|got|been|was being|were) called",
    r"(?:he|she|they|someone|somebody) (?:said|told me|texted|wrote|posted|messaged) (?:that )?(?:i|im|my)",
]

# Words of affection.
AFFECTION = r"love you|love u|luv you|luv u|ily|ilysm|ly|jk|just kidding|jking|kidding|bestie|no hate|all love"

# Words of which any match of the rule has one (a test derives them from the patterns): a text without any is not searched for it.
TRIGGERS = {
    "kill yourself": "self urself uself yaself yoself yourself yourselves",
    "kys": "k kill kys",
    "go die": "choke dead die forever rot starve",
    "just disappear": "disappear forever leave stop vanish",
    "die in a fire": "bleach car dead ditch fire gutter hole jump slit traffic",
    "hope you die": "hope pray praying wish",
    "nobody would miss you": "dead die died disappear disappeared gone kill killed left miss mourn",
    "happier if you were gone": "better happier",
    "better without you": "without",
    "you should die": "alive born dead die end exist forever kill stop",
    "should have been aborted": "aborted wish wished",
    "do the world a favor": "favor favour",
    "dont deserve to live": "commit deserve unalive",
    "i will hurt you": "bash beat break burn choke drown hurt jump kill knock murder punch rape shoot slap smack sock stab stomp strangle",
    "beat you up": "beat beating kick knock punch slap",
    "violence": "bomb bring shoot",
    "i know where you live": "address eye find happen hunt watch where",
    "you're dead": "come coming dead hope messed pay regret watch",
    "sexual threat": "nudes photos pics pictures rape",
    "veiled": "accidents careful if",
    "kill you": "kill murder shoot stab strangle",
    "destroy you": "bury cook destroy end ruin smoke wreck",
    "go fuck yourself": "fk fuck gfy screw",
    "fuck you": "f fk fuck screw",
    "go to hell": "hell",
    "shut the fuck up": "shut stfu",
    "crude": "ass bite eat fuck hell piss suck tf",
    "i hate you": "despise despises hate hates stand",
    "nobody likes you": "cares date ever gives liked likes love loves needs want wanted wants",
    "nobody sits with you": (
        "call calls chooses eat eats hang hangs invite invites pick picks play plays sit sits stand stands talk talks text texts "
        "walk walks"),
    "die alone": "alone ditch lonely sad soon unloved virgin young",
    "you make me sick": "cringe die nauseous puke sick throw vomit",
    "the reason": "problem reason",
    "make your life hell": "bleed cry hard hell miserable nightmare pay regret suffer worse",
    "you belong in a zoo": "asylum barn cage circus dumpster garbage grave ground gutter hospital kennel landfill pigpen sewer trash ward zoo",
    "no wonder they left": "wonder",
    "nobody will date you": "ever",
    "deserve to suffer": "deserve deserved deserves",
    "imagine being this ugly": "imagine",
    "you're the worst": "nightmare worst",
    "you will never": "never",
    "waste of space": "waste wastes",
    "you suck": "stink stinks suck sucks",
    "you look like": (
        "alien ape bitch clown corpse cow crackhead creep dog foot freak garbage goblin gorilla gremlin hag hippo homeless hooker "
        "horse loser man monkey ogre pedo pedophile pig potato prostitute rapist rat retard shit skeleton slut terrorist thumb "
        "toe tranny trash troll virgin walrus whale whore witch zombie"),
    "go back to your country": "came cave country hole homeland people",
    "your parents": "aborted ashamed didnt disappointed disgusted doesnt dont embarrassed hate hates loved regret regrets wanted",
    "you are nothing": "burden dead forgettable matter mistake nothing replaceable unloved unwanted waste",
    "everyone laughs at you": "fun laughed laughing laughs shit",
    "no friends": "alone friends life loner wonder",
    "sexual harassment": "send show",
    "ugly af": "af asf fuck hell",
    "get a life": "account cares cope cry grass issue life womp",
    "shut up": "shut",
}
REPORTING_TRIGGERS = "call called calling calls messaged phrase post posted posting said say saying slur tell telling term texted told use using word write writing wrote"
AFFECTION_TRIGGERS = "bestie hate ily ilysm jk jking kidding love luv ly"
