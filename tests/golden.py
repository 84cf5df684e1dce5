"""Golden cases (text, label, urgency) of the rule engine."""

from meridex.functions.vocabulary import ABSCESS, DEEP, GINGIVITIS, IRREVERSIBLE, REVERSIBLE, SURFACE, UNCLEAR

CASES = [
    ("ألم شديد مستمر يوقظني من النوم", IRREVERSIBLE, "Urgent"),
    ("عندي تورم وألم", ABSCESS, "Urgent"),
    ("ألم مستمر ونبضي", IRREVERSIBLE, "Urgent"),
    ("وجع شديد مستمر بالليل", IRREVERSIBLE, "Urgent"),
    ("يوجعني ضرسي وجع شديد مستمر لا يهدأ", IRREVERSIBLE, "Urgent"),
    ("ألم نابض ومستمر طول اليوم", IRREVERSIBLE, "Urgent"),
    ("الألم بالليل شديد ولا يحتمل", IRREVERSIBLE, "Urgent"),
    ("ألم لا يحتمل يمنعني من النوم", IRREVERSIBLE, "Urgent"),
    ("ألم مستمر وينبض في الضرس", IRREVERSIBLE, "Urgent"),
    ("ألم شديد ومستمر في الضرس السفلي", IRREVERSIBLE, "Urgent"),
    ("في قيح حول السن", ABSCESS, "Urgent"),
    ("تورم في الخد وألم شديد", ABSCESS, "Urgent"),
    ("عندي خراج في اللثة", ABSCESS, "Urgent"),
    ("يخرج صديد من اللثة", ABSCESS, "Urgent"),
    ("ورم في اللثة مع وجع", ABSCESS, "Urgent"),
    ("الوجه منتفخ وفيه ألم", ABSCESS, "Urgent"),
    ("تقيح حول الضرس", ABSCESS, "Urgent"),
    ("بدون ورم ولا قيح وعندي ألم عند المضغ", DEEP, "Non-Urgent"),
    ("ما في تورم ولا قيح بس ألم عند الضغط على السن", DEEP, "Non-Urgent"),
    ("لا يوجد تورم ولا صديد والألم عند المضغ", DEEP, "Non-Urgent"),
    ("ما في ورم ولا قيح والسن فيه حفرة وألم عند الأكل", DEEP, "Non-Urgent"),
    ("بدون ألم تلقائي أو تورم. ألم لحظي مع البارد ثم يزول", REVERSIBLE, "Non-Urgent"),
    ("ألم قوي في الضرس منذ يومين. لا توجد تورم أو قيح", UNCLEAR, "Non-Urgent"),
    ("عم حس بوجع قوي بالضرس. مو ورم ولا قيح", UNCLEAR, "Non-Urgent"),
    ("لا يوجد ورم. عندي قيح حول السن", ABSCESS, "Urgent"),
    ("ما في تورم. تورم ظهر اليوم مع ألم", ABSCESS, "Urgent"),
    ("أريد فحصا دوريا. ولا يوجد ألم أو تورم. آخر فحص منذ ستة أشهر", UNCLEAR, "Non-Urgent"),
    ("أريد تقييما دوريا. ولا يوجد ألم عند المضغ", UNCLEAR, "Non-Urgent"),
    ("بدي متابعة. وما في حساسية مع البارد أو الحار", UNCLEAR, "Non-Urgent"),
    ("بدون تورم", UNCLEAR, "Non-Urgent"),
    ("لا يوجد قيح", UNCLEAR, "Non-Urgent"),
    ("لا يوجد ألم", UNCLEAR, "Non-Urgent"),
    ("ما في وجع ولا تورم", UNCLEAR, "Non-Urgent"),
    ("ما في تورم بس ألم شديد", UNCLEAR, "Non-Urgent"),
    ("لا يوجد ألم ليلي", UNCLEAR, "Non-Urgent"),
    ("ما عندي ألم مستمر", UNCLEAR, "Non-Urgent"),
    ("بدون ألم شديد", UNCLEAR, "Non-Urgent"),
    ("ألم مع البارد يختفي بسرعة", REVERSIBLE, "Non-Urgent"),
    ("حساسية للمشروبات الساخنة تزول بعد ثواني", REVERSIBLE, "Non-Urgent"),
    ("الضرس يوجعني مع الحار ويروح بعد لحظات", REVERSIBLE, "Non-Urgent"),
    ("لما أشرب ماء بارد يوجع ثواني ويروح", REVERSIBLE, "Non-Urgent"),
    ("ألم مؤقت مع الحلو", REVERSIBLE, "Non-Urgent"),
    ("ألم عند المضغ في السن", DEEP, "Non-Urgent"),
    ("يوجع عند العض على الضرس", DEEP, "Non-Urgent"),
    ("في حفرة كبيرة في السن وألم عند الأكل", DEEP, "Non-Urgent"),
    ("ألم عند الضغط على السن", DEEP, "Non-Urgent"),
    ("ألم أثناء الأكل في ضرس مسوس", DEEP, "Non-Urgent"),
    ("تسوس عميق وألم مع المضغ", DEEP, "Non-Urgent"),
    ("حساسية خفيفة من الحلو", SURFACE, "Non-Urgent"),
    ("بقعة بنية وحساسية من البارد", SURFACE, "Non-Urgent"),
    ("أحس بحساسية عند الحلويات", SURFACE, "Non-Urgent"),
    ("نزيف في اللثة عند التفريش", GINGIVITIS, "Non-Urgent"),
    ("اللثة تنزف كل يوم", GINGIVITIS, "Non-Urgent"),
    ("دم من اللثة عند استخدام الخيط", GINGIVITIS, "Non-Urgent"),
    ("لثتي حمراء وتنزف", GINGIVITIS, "Non-Urgent"),
    ("نزيف عند التفريش ومعها حساسية في اللثة", GINGIVITIS, "Non-Urgent"),
    ("دم عند استخدام الخيط", GINGIVITIS, "Non-Urgent"),
    ("ما في دم بس اللثة حمراء", UNCLEAR, "Non-Urgent"),
    ("", UNCLEAR, "Non-Urgent"),
    ("مرحبا", UNCLEAR, "Non-Urgent"),
    ("عندي صداع", UNCLEAR, "Non-Urgent"),
    ("ألم في قدمي", UNCLEAR, "Non-Urgent"),
    ("tooth pain", UNCLEAR, "Non-Urgent"),
    ("اشتريت ندم", UNCLEAR, "Non-Urgent"),
    ("عندي ألم في القدم والندم", UNCLEAR, "Non-Urgent"),
    ("عندي حرارة وتورم في اللثة", ABSCESS, "Urgent"),
    ("صعوبة في البلع وألم في السن", UNCLEAR, "Urgent"),
    ("صعوبة التنفس مع ألم الأسنان", UNCLEAR, "Urgent"),
    ("لا أستطيع فتح فمي بعد قلع الضرس", UNCLEAR, "Urgent"),
    ("نزيف لا يتوقف بعد خلع السن", UNCLEAR, "Urgent"),
    ("سقطت وانكسر السن", UNCLEAR, "Urgent"),
    ("تورم الوجه وألم", ABSCESS, "Urgent"),
    ("تعرضت لحادث وألم في الفك", UNCLEAR, "Urgent"),
]
