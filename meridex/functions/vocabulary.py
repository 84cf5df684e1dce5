"""Fixed values of the triage domain: labels, lexicons, dialect map, affixes, negators, thresholds and messages."""

# Labels in report order, urgency values, red-flag codes, splits.
ABSCESS, IRREVERSIBLE, REVERSIBLE = "خراج سني", "التهاب عصب غير عكوس", "التهاب عصب عكوس"
DEEP, SURFACE, GINGIVITIS, UNCLEAR = "تسوس عميق", "تسوس سطحي", "التهاب لثة", "غير واضح حالياً"
LABELS = [ABSCESS, IRREVERSIBLE, REVERSIBLE, DEEP, SURFACE, GINGIVITIS, UNCLEAR]
URGENT, NON_URGENT = "Urgent", "Non-Urgent"
RED_FLAG_CODES = ["trismus", "dysphagia", "breathing_difficulty", "uncontrolled_bleeding", "trauma", "spreading_facial_swelling", "fever_with_swelling_or_pus"]
SPLITS = ["dev", "test"]
CRITICAL = [ABSCESS, IRREVERSIBLE]
SEVERITY_OF = {ABSCESS: "High", IRREVERSIBLE: "High", REVERSIBLE: "Moderate", DEEP: "Moderate", SURFACE: "Low", GINGIVITIS: "Low", UNCLEAR: "Low"}
SAFE_UPGRADES = {
    SURFACE: [REVERSIBLE], DEEP: [REVERSIBLE, IRREVERSIBLE], REVERSIBLE: [IRREVERSIBLE], GINGIVITIS: [],
    UNCLEAR: [SURFACE, DEEP, REVERSIBLE, IRREVERSIBLE, ABSCESS, GINGIVITIS],
}
MIN_SCORE, MIN_MARGIN, MODEL_VERSION = 0.52, 0.05, "arabert_symptoms_v1"

# Dialect and typo forms of whole tokens, and the clitic prefixes that may stand before them.
DIALECT = {
    "يوجعني": "الم", "بيوجعني": "الم", "بتوجعني": "الم", "وجعني": "الم", "يوجعك": "الم", "بيوجع": "الم", "بتوجع": "الم",
    "يوجع": "الم", "وجع": "الم", "واجع": "الم", "موجع": "الم", "حساس": "محفز", "حساسيه": "محفز", "حار": "ساخن",
    "تقيح": "قيح", "صديد": "قيح", "تنزف": "نزيف", "ينزف": "نزيف", "دم": "نزيف", "ورم": "تورم", "منتفخ": "تورم",
    "انتفاخ": "تورم", "ينتفخ": "تورم", "ضرس": "سن", "ضروس": "سن", "سناني": "سن", "اسناني": "سن",
}
CLITICS = ["وال", "بال", "فال", "كال", "لل", "ال", "و", "ف", "ب", "ل", "ك"]
SUFFIXES = ["ات", "ين", "ان", "ها", "ه", "ي", "ك", "ت"]

# Negators, the one that reaches only its neighbour, and words that end a negation's scope.
NEGATORS = [
    "بدون", "ما في", "مافي", "ما فيه", "مفيش", "لا يوجد", "لايوجد", "ما عندي", "ماعندي", "ما عندنا", "مو موجود",
    "ما اعاني من", "لا اعاني من", "ما اشعر ب", "ليس", "ليس لدي", "عدم", "خالي من", "مش", "مو", "غير", "ولا", "لا توجد", "ما توجد",
]
ADJACENT = "ولا"
OR = "او"
BREAKERS = ["|", "بس", "لكن", "ولكن", "الا", "انما", "عندي", "وعندي", "فيه", "وفيه", "كمان", "وكمان", "اشعر", "واشعر", "اعاني", "واعاني", "احس", "واحس"]

# Lexicons of the label rules.
RULES = {
    "swelling": ["تورم", "منتفخ", "انتفاخ", "ورم"],
    "pus": ["قيح", "صديد", "خراج", "تقيح"],
    "pain": ["ألم", "وجع", "يوجع", "يوجعني", "توجع"],
    "night": ["بالليل", "ليلي", "ليلا", "يوقظني", "يمنعني من النوم", "لا استطيع النوم", "يزداد بالليل"],
    "persistent": ["مستمر", "مستمره", "متواصل", "لا يهدأ", "لا يزول", "لا يختفي", "لا يروح", "لا يتوقف", "طول اليوم", "يزداد مع الوقت", "دائم"],
    "throbbing": ["نبضي", "ينبض", "نابض", "خافق", "نبض"],
    "severe": ["شديد", "شديده", "شديد جدا", "لا يحتمل", "بقوه", "قوي", "فظيع", "رهيب", "مبرح"],
    "stimulus": ["بارد", "ساخن", "حار", "حلو", "حلويات", "سكريات", "حلوى", "مشروبات"],
    "surface_stimulus": ["بارد", "حلو", "حلويات", "سكريات", "حلوى", "برودة"],
    "transient": ["يختفي", "يزول", "يروح", "ثواني", "لحظات", "لحظي", "لحظيا", "مؤقت", "عابر", "سريع"],
    "chewing": ["عند المضغ", "مع المضغ", "عند العض", "مع العض", "عند الضغط", "مع الضغط", "عند الاكل", "اثناء الاكل", "المضغ"],
    "cavity": ["تسوس", "نخر", "ثقب", "حفره", "تجويف"],
    "gum": ["لثه", "اللثه", "لثتي", "لثتك"],
    "gum_context": ["التفريش", "تفريش", "الفرشاه", "فرشاه", "الخيط", "خيط الاسنان", "السواك"],
    "bleeding": ["نزيف", "تنزف", "ينزف", "دم"],
    "tooth": ["سن", "ضرس"],
    "fever": ["حمى", "حراره", "سخونه"],
    "face_swelling": ["تورم الوجه", "تورم في الوجه", "انتفاخ الوجه", "الوجه منتفخ", "تورم الخد", "تورم في الخد"],
}

# Lexicons of the urgency rules, which differ from those of the label rules.
URGENCY = {
    "swelling": ["تورم", "منتفخ", "انتفاخ", "ورم"],
    "pus": ["قيح", "صديد", "خراج", "تقيح"],
    "pain": ["ألم", "وجع", "يوجع", "يوجعني"],
    "unrelieved": ["مستمر", "لا يهدأ", "لا يزول", "لا يختفي", "لا يتوقف", "طول اليوم", "يزداد مع الوقت", "بقوه", "شديد", "لا يحتمل"],
    "night": ["بالليل", "ليلي", "ليلا", "يوقظني", "يمنعني من النوم"],
    "fever": ["حمى", "حراره", "سخونه", "ارتفاع حراره"],
}
RED_FLAGS = {
    "trismus": ["صعوبة فتح الفم", "صعوبة في فتح الفم", "لا استطيع فتح فمي", "تشنج الفك"],
    "dysphagia": ["صعوبة البلع", "صعوبة في البلع", "لا استطيع البلع"],
    "breathing_difficulty": ["صعوبة التنفس", "صعوبة في التنفس", "ضيق التنفس", "ضيق نفس"],
    "uncontrolled_bleeding": ["نزيف لا يتوقف", "نزيف غزير", "نزيف شديد", "لا يتوقف النزيف"],
    "trauma": ["ضربة", "حادث", "كسر", "سقطت", "اصطدام", "رضه"],
    "spreading_facial_swelling": ["تورم الوجه", "تورم في الوجه", "انتفاخ الوجه", "تورم العين", "تورم الرقبه", "تورم تحت الفك", "ورم الوجه"],
}

# Patient messages, and the note of the third response.
EXPLAIN_URGENT = "الأعراض الحالية تشير إلى حالة تحتاج متابعة فورية لدى طبيب الأسنان، خصوصاً مع وجود علامات عدوى أو ألم شديد. ننصحك بزيارة الطوارئ أو حجز أقرب موعد ممكن، وتجنب الضغط أو الحرارة على السن حتى الفحص. في حال ظهور تورم بالوجه أو صعوبة في البلع/التنفس، يجب التوجه للطوارئ مباشرة."
EXPLAIN_MODERATE = "يوجد مؤشرات التهاب في العصب أو تسوس عميق يسبب ألماً عند البارد/الحار أو الضغط. من الأفضل حجز موعد خلال أيام قليلة لعمل فحص وأشعة، مع استخدام مسكنات آمنة عند الحاجة. تجنب المهيجات مثل المشروبات شديدة السخونة/البرودة إلى أن يتم العلاج."
EXPLAIN_LOW = "الأعراض تبدو خفيفة حالياً وقد ترتبط بتسوس سطحي أو التهاب لثة بسيط. حافظ على التفريش والخيط مرتين يومياً، وتجنب الحلويات والحمضيات الزائدة. إذا زادت الأعراض أو ظهر تورم/نزيف مستمر، احجز موعداً للفحص."
EXPLAIN_ELSE = "الأعراض غير واضحة تماماً حالياً، ويُفضل مراقبتها. إذا استمر الألم أو زادت حدته أو ظهر تورم/نزيف، يرجى حجز فحص لدى طبيب الأسنان. العناية اليومية الجيدة قد تساعد على تقليل التهيج حتى يتحدد السبب."
NOTE = "النتائج تعتمد على الأعراض النصية فقط وليست تشخيصاً نهائياً"

# Prototype sentences of each label, in order.
PROTOTYPES = {
    ABSCESS: ["تورم في الوجه مع قيح وألم شديد في الضرس", "انتفاخ وانتشار قيح حول اللثة مع ألم لا يحتمل", "ورم وصديد في نفس السن وألم يزيد مع الضغط"],
    IRREVERSIBLE: ["ألم شديد مستمر يوقظني من النوم", "ألم نبضي لا يهدأ ويزيد بالليل", "ألم حارق قوي طوال اليوم ولا يزول"],
    REVERSIBLE: ["ألم مع البارد يختفي بسرعة بعد ثواني", "حساسية مع الحلو أو البارد ثم يزول الألم", "يوجع مع المشروبات الباردة لكن يرتاح بعد إزالتها"],
    DEEP: ["ألم عند المضغ أو الضغط على السن مع حفرة واضحة", "تجويف في الضرس وألم قوي عند الأكل", "ثقب في السن يسبب ألم مع العض"],
    SURFACE: ["حساسية بسيطة مع البارد أو الحلو وتزول بسرعة", "ألم خفيف مع العصير البارد لكن لا يستمر", "وخز مع الحلويات يذهب بعد لحظات"],
    GINGIVITIS: ["نزيف عند التفريش مع لثة حمراء", "دم من اللثة وانتفاخ بسيط", "اللثة تنزف بسهولة مع ريحة فم"],
    UNCLEAR: ["الأعراض غير واضحة", "لا أستطيع وصف الألم بدقة"],
}
