"""Sentences written after the name tagger was finished and scored once; the tagger must not be changed to fit them."""

FRESH = [
    ("The roof was repaired by Gwendolyn Ashby in autumn.", ["Gwendolyn Ashby"]), ("Seat 14C: Tariq Mansour", ["Tariq Mansour"]), ("Regards\nMilena Stojanovic", ["Milena Stojanovic"]),
    ("Could you send the ledger to Oscar Lindgren?", ["Oscar Lindgren"]), ("We hired Beatrix Caldwell and Amos Fairbank.", ["Beatrix Caldwell", "Amos Fairbank"]), ("Guarantor: Nwosu, Chidi", ["Nwosu, Chidi"]),
    ("R. Pennington wrote the clause.", ["R. Pennington"]), ("my cousin Dalia Rosen lives there", ["Dalia Rosen"]), ("Mrs. Edith Goldsworthy complained.", ["Edith Goldsworthy"]), ("booked for Kofi Mensah, two nights", ["Kofi Mensah"]),
    ("ticket raised by Saoirse Byrne at 9", ["Saoirse Byrne"]), ("Driver MARCUS HOLLOWAY arrived late.", ["MARCUS HOLLOWAY"]), ("Speak to Leif A. Sorensen first.", ["Leif A. Sorensen"]), ("The will names Harriet Longbottom as heir.", ["Harriet Longbottom"]),
    ("Der Vertrag wurde von Ottilie Brenner unterschrieben.", ["Ottilie Brenner"]), ("Herr Volkmar Dietz ist krank.", ["Volkmar Dietz"]), ("Rechnung an Wiebke Hansen", ["Wiebke Hansen"]), ("Gestern rief Egon Pfeiffer an.", ["Egon Pfeiffer"]),
    ("La casa es de Inmaculada Robles.", ["Inmaculada Robles"]), ("Lo vio Fermín Aguirre ayer.", ["Fermín Aguirre"]), ("Un abrazo,\nRocío Benavides", ["Rocío Benavides"]), ("Paciente: Eusebio Carrasco", ["Eusebio Carrasco"]),
    ("邻居黄晓燕送来的", ["黄晓燕"]), ("医生何俊杰今天休息", ["何俊杰"]), ("合同甲方：宋佳怡。", ["宋佳怡"]), ("我和谢文斌吃饭", ["谢文斌"]), ("班长许静回来了", ["许静"]), ("押金退给罗志强", ["罗志强"]), ("沈雅婷女士未到", ["沈雅婷"]), ("联系人是丁磊，下午有空", ["丁磊"]),
]
FRESH_NONE = [
    "The Silver Lining Festival opens on Saturday.", "Install Visual Basic before the Second Reboot.", "Lake Geneva froze in winter.", "Die Deutsche Bahn streikt.", "La Semana Santa empieza pronto.", "The Supreme Court ruled.", "Press Enter, Then Escape", "Kernel Panic on Boot", "North Sea Oil prices fell",
    "今天天气很好", "高铁票已经卖完", "金属价格上涨", "程序员需要休息", "安全帽不见了", "时钟慢了五分钟",
]
