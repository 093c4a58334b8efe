"""Fixed values of the inventory report: names, units, labels and texts."""

# Column, kind, label, unit, other headers.
COLUMNS = (
    ("stok_kodu", "text", "Stok Kodu", "sayi", "stok kodu", "urun_kodu", "sku"),
    ("urun_adi", "text", "Ürün Adı", "sayi", "urun adi", "malzeme_adi"),
    ("kategori", "text", "Kategori", "sayi", "urun_kategorisi"),
    ("depo", "text", "Depo", "sayi", "depo_adi", "ambar"),
    ("donem", "period", "Dönem", "sayi", "period", "ay", "donem_kodu"),
    ("giris_miktar", "decimal", "Giriş", "adet", "giris", "giris_miktari"),
    ("cikis_miktar", "decimal", "Çıkış", "adet", "cikis", "cikis_miktari"),
    ("donem_sonu_stok", "decimal", "Dönem Sonu Stok", "adet", "son_stok", "kalan_stok"),
    ("birim_maliyet_tl", "decimal", "Birim Maliyet", "TL", "birim_maliyet", "maliyet"),
    ("birim_satis_tl", "decimal", "Birim Satış Fiyatı", "TL", "birim_satis", "satis_fiyati"),
)

# Series column -> (label, unit).
METRICS = {
    "ciro_tl": ("Ciro", "TL"),
    "satis_maliyeti_tl": ("Satış Maliyeti", "TL"),
    "brut_kar_tl": ("Brüt Kâr", "TL"),
    "marj_yuzde": ("Brüt Marj", "%"),
    "stok_degeri_tl": ("Stok Değeri", "TL"),
    "net_akis": ("Net Stok Akışı", "adet"),
    "onceki_stok": ("Önceki Dönem Stoğu", "adet"),
    "cikis_ort3": ("Çıkış (3 Dönem Ort.)", "adet"),
    "cikis_mom_yuzde": ("Çıkış Değişimi (Aylık)", "%"),
    "maliyet_mom_yuzde": ("Birim Maliyet Değişimi (Aylık)", "%"),
    "marj_delta_puan": ("Marj Değişimi (Puan)", "%"),
    "kapama_ay": ("Stok Kapama Süresi", "ay"),
    "mutabakat_farki": ("Stok Mutabakat Farkı", "adet"),
    "arz_kisitli": ("Arz Kısıtlı", "sayi"),
}

# Period total -> (label, unit).
PERIOD_AGGREGATES = {
    "toplam_ciro_tl": ("Toplam Ciro", "TL"),
    "toplam_brut_kar_tl": ("Brüt Kâr", "TL"),
    "ortalama_marj_yuzde": ("Ağırlıklı Marj", "%"),
    "toplam_stok_degeri_tl": ("Stokta Bağlı Sermaye", "TL"),
    "tukenen_urun_sayisi": ("Stoğu Tükenen Ürün", "sayi"),
    "toplam_cikis": ("Toplam Çıkış", "adet"),
    "toplam_giris": ("Toplam Giriş", "adet"),
    "toplam_stok_adet": ("Toplam Stok", "adet"),
}

# Entity column -> (label, unit).
ENTITY_AGGREGATES = {
    "toplam_ciro_tl": ("Toplam Ciro", "TL"),
    "toplam_brut_kar_tl": ("Brüt Kâr", "TL"),
    "son_stok": ("Son Stok", "adet"),
    "ilk_stok": ("İlk Stok", "adet"),
    "son_kapama_ay": ("Stok Kapama", "ay"),
    "son_marj_yuzde": ("Son Marj", "%"),
    "ilk_marj_yuzde": ("İlk Marj", "%"),
    "marj_degisim_puan": ("Marj Değişimi", "%"),
    "son_birim_maliyet": ("Son Birim Maliyet", "TL"),
    "maliyet_degisim_yuzde": ("Maliyet Değişimi", "%"),
    "son_birim_satis": ("Son Satış Fiyatı", "TL"),
    "son_stok_degeri_tl": ("Bağlı Sermaye", "TL"),
    "sifir_stok_donem": ("Stoksuz Dönem Sayısı", "sayi"),
    "ilk_sifir_donem": ("İlk Stoksuz Dönem", "sayi"),
    "arz_kisitli_donem": ("Arz Kısıtlı Dönem", "sayi"),
    "ilk_cikis": ("İlk Dönem Çıkış", "adet"),
    "son_cikis": ("Son Dönem Çıkış", "adet"),
    "ortalama_cikis": ("Ortalama Çıkış", "adet"),
    "ilk3_cikis_ort": ("İlk 3 Dönem Ort. Çıkış", "adet"),
    "son3_cikis_ort": ("Son 3 Dönem Ort. Çıkış", "adet"),
    "zirve_cikis": ("Zirve Çıkış", "adet"),
    "zirve_donem": ("Zirve Dönemi", "sayi"),
    "net_akis_toplam": ("Net Stok Akışı", "adet"),
    "stok_trend_step": ("Stok Eğilimi (Dönem Başı)", "adet"),
    "cikis_trend_step": ("Çıkış Eğilimi (Dönem Başı)", "adet"),
    "maliyet_sok_donem": ("Maliyet Şokunun Yaşandığı Dönem", "sayi"),
    "marj_dusus_donem": ("Marjın Düştüğü Dönem", "sayi"),
    "kritik_kapama_donem": ("Kritik Kapamaya Düşülen Dönem", "sayi"),
    "olu_stok_donem": ("Ölü Stoğa Geçilen Dönem", "sayi"),
    "yavas_donem": ("Yavaşlamanın Başladığı Dönem", "sayi"),
    "talep_patlama_donem": ("Talebin Hızlandığı Dönem", "sayi"),
}

# Dimension total -> (label, unit).
DIMENSION_AGGREGATES = {
    "toplam_ciro_tl": ("Ciro", "TL"),
    "toplam_brut_kar_tl": ("Brüt Kâr", "TL"),
    "ortalama_marj_yuzde": ("Marj", "%"),
    "toplam_stok_degeri_tl": ("Stok Değeri", "TL"),
    "toplam_cikis": ("Çıkış", "adet"),
    "urun_sayisi": ("Ürün Sayısı", "sayi"),
}

# Imputation title and detail by target column.
IMPUTATION = {
    "giris_miktar": (
        "Eksik giriş/çıkış miktarları ürünün kendi ortancasından tamamlandı",
        "Eksik giriş miktarı, aynı ürünün diğer dönemlerindeki ortanca değerle dolduruldu. "
        "Ortalama yerine ortanca: tek bir uç değer tahmini bozmasın.",
    ),
    "cikis_miktar": (
        "Eksik çıkış miktarları ürünün kendi ortancasından tamamlandı",
        "Eksik çıkış miktarı aynı ürünün dönemler arası ortanca değeriyle dolduruldu.",
    ),
    "donem_sonu_stok": (
        "Eksik dönem sonu stoğu mutabakattan türetildi",
        "Boş bırakılan dönem sonu stoğu, stok mutabakatı denkleminden hesaplandı: önceki dönem "
        "sonu + giriş - çıkış. Aynı değer bir de sonraki dönemden geriye doğru doğrulandı.",
    ),
}

# Integrity rule title and detail by code.
INTEGRITY = {
    "RECONCILIATION_BREAK": (
        "Stok mutabakatı tutmuyor",
        "{count} kayıtta 'önceki dönem sonu + giriş - çıkış' hesabı raporlanan dönem sonu "
        "stoğuyla örtüşmüyor. Kaynak sistemde sayım düzeltmesi, fire veya kayıt atlaması olabilir.",
    ),
    "NEGATIVE_VALUE": (
        "Negatif miktar",
        "{count} kayıtta negatif miktar var; fiziksel olarak mümkün değil.",
    ),
    "MARGIN_INVERSION": (
        "Maliyet satış fiyatına eşit ya da üstünde",
        "{count} kayıtta ürün maliyetine eşit ya da altında satılıyor.",
    ),
    "COST_SPIKE": (
        "Birim maliyette ani sıçrama",
        "{count} kayıtta birim maliyet bir önceki döneme göre %10 üzerinde arttı. Tedarikçi fiyat "
        "güncellemesi veya kur etkisi olabilir; satış fiyatı aynı kaldıysa marj doğrudan eriyor.",
    ),
}

# Risk title, narrative and recommendation by code.
RISKS = {
    "STOCKOUT": (
        "Stok tükenmiş -- satış tedarikle sınırlı",
        "{sifir_stok_donem:d} dönemdir stok sıfır. Bu dönemlerin {arz_kisitli_donem:d} tanesinde "
        "çıkış girişe kilitlenmiş durumda -- yani satışı talep değil tedarik belirliyor.",
        "Tedarik siparişini acil büyütün. Bu ürün kârlı ve talep var; kısıt tarafınızda. "
        "Tedarikçi teslim süresini ve minimum sipariş miktarını gözden geçirin.",
    ),
    "STOCKOUT_IMMINENT": (
        "Stok tükenmesine çok az kaldı",
        "Mevcut stok son 3 dönemin çıkış hızına göre yalnızca {son_kapama_ay:.1f} ay yetiyor. "
        "Bu hızla devam ederse önümüzdeki dönem içinde tükenir.",
        "Sipariş açın; tedarik süresi kapama süresinden uzunsa şimdiden geç kalınmış demektir.",
    ),
    "DEAD_STOCK": (
        "Ölü stok -- sermaye bağlı",
        "Depoda {son_stok:.0f} adet var ve mevcut çıkış hızıyla {son_kapama_ay:.1f} ay yetiyor. "
        "{son_stok_degeri_tl:tl} sermaye bu üründe bağlı duruyor.",
        "Yeni alımı durdurun. Kampanya, paket satış veya kanal değişikliğiyle stoğu eritmeyi "
        "değerlendirin.",
    ),
    "SLOW_MOVER": (
        "Yavaş hareket eden ürün",
        "Stok kapama süresi {son_kapama_ay:.1f} ay. Kritik değil ama {son_stok_degeri_tl:tl} "
        "sermaye ortalamanın üzerinde bir süre depoda bekliyor.",
        "Sipariş miktarını küçültüp frekansı artırın; bağlı sermaye düşer.",
    ),
    "MARGIN_EROSION": (
        "Marj eriyor",
        "Brüt marj %{ilk_marj_yuzde:.1f} seviyesinden %{son_marj_yuzde:.1f} seviyesine geriledi "
        "({marj_degisim_puan:.1f} puan). Aynı dönemde birim maliyet %{maliyet_degisim_yuzde:.1f} "
        "değişti; satış fiyatı bu artışı karşılamamış.",
        "Satış fiyatını güncelleyin ya da tedarikçi ile fiyat görüşmesi açın. İkisi de mümkün "
        "değilse ürünün portföydeki yerini sorgulayın.",
    ),
    "COST_SHOCK": (
        "Birim maliyet kalıcı olarak yükseldi",
        "Birim maliyet dönem başından bu yana %{maliyet_degisim_yuzde:.1f} arttı ve "
        "{son_birim_maliyet:.0f} TL seviyesine oturdu.",
        "Fiyat listesini gözden geçirin; maliyet artışı kalıcı ise fiyata yansıtılmalı.",
    ),
    "SILENT_ACCUMULATION": (
        "Sessiz stok birikimi",
        "Her dönem ortalama {stok_trend_step:.0f} adet stok birikiyor: giriş çıkışı aşıyor ve "
        "talep artmıyor. Tek bir dönem alarma geçmiyor ama trend {ilk_stok:.0f} adetten "
        "{son_stok:.0f} adete çıkmış durumda.",
        "Sipariş miktarını çıkış hızına eşitleyin; aksi halde ölü stoğa dönüşür.",
    ),
    "DEMAND_SURGE": (
        "Talep hızlanıyor",
        "Dönemsel çıkış ilk 3 ayda ortalama {ilk3_cikis_ort:.0f} adetken son 3 ayda "
        "{son3_cikis_ort:.0f} adete çıktı. Bu bir fırsat, ama stok bu hıza hazır değilse tükenme "
        "riski de beraberinde geliyor.",
        "Tedarik planını yukarı revize edin; büyüme trendini stoksuzluk kesmesin.",
    ),
    "SEASONAL_PEAK": (
        "Mevsimsel tepe tespit edildi",
        "Çıkış {zirve_donem} döneminde {zirve_cikis:.0f} adetle zirve yaptı; dönem ortalaması "
        "{ortalama_cikis:.0f} adet. Düz bir trend değil, mevsimsel bir hareket var.",
        "Gelecek yıl aynı dönem için stoğu önceden planlayın.",
    ),
    "DYING_SKU": (
        "Sönümlenen ürün",
        "Dönemsel çıkış {ilk_cikis:.0f} adetten {son_cikis:.0f} adete geriledi ve hacim zaten "
        "düşük. Ürün portföyde yer kaplamaya devam ediyor.",
        "Portföyden çıkarmayı ya da siparişi tamamen durdurmayı değerlendirin.",
    ),
}

# Fixed value: added to the STOCKOUT narrative when outflow fell from first to last period.
STOCKOUT_LOST_SALES = (
    " Tükenmeden önceki dönemsel çıkış {ilk_cikis:.0f} adetken şimdi {son_cikis:.0f} adete "
    "düşmüş; aradaki fark kaçırılan satış."
)
