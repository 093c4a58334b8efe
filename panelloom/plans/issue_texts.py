"""Quality issues as code -> (title, severity, action, detail)."""

ISSUES = {
    "ENCODING_REPAIRED": (
        "Karakter kodlaması bozukluğu onarıldı",
        "orta",
        "onarildi",
        "Dosya UTF-8 iken CP1252 olarak okunup tekrar kaydedilmiş (mojibake). Türkçe karakterler "
        "geri kazanıldı.",
    ),
    "ENCODING_SUSPECT": (
        "Karakter kodlaması şüpheli, güvenli onarım yapılamadı",
        "yuksek",
        "isaretlendi",
        "Metinde mojibake izi var ancak geri dönüşü kayıpsız değil. Veriyi bozmamak için "
        "dokunulmadı; kaynak export'un kodlaması kontrol edilmeli.",
    ),
    "UNKNOWN_COLUMNS": (
        "Şemada tanımlı olmayan kolonlar yok sayıldı",
        "bilgi",
        "isaretlendi",
        "Bu kolonlar analize dahil edilmedi.",
    ),
    "MISSING_DETECTED": (
        "'{label}' alanında eksik/okunamayan değer",
        "bilgi",
        "isaretlendi",
        "{count} satırda değer boş ya da sayıya çevrilemedi. Tamamlama kuralları bir sonraki "
        "adımda denenecek.",
    ),
    "INVALID_PERIOD_FORMAT": (
        "Dönem formatı beklenen YYYY-AA kalıbına uymuyor",
        "yuksek",
        "karantina",
        "Bu satırlar zaman serisine dahil edilemez.",
    ),
    "DUPLICATE_EXACT": (
        "Birebir aynı satırlar kaldırıldı",
        "orta",
        "silindi",
        "{count} satır tüm kolonlarıyla birebir tekrar ediyordu. ERP export'larında "
        "sayfalama/birleştirme hatasının tipik izi. Toplamları şişmemesi için tekil hale "
        "getirildi.",
    ),
    "DUPLICATE_KEY": (
        "Aynı dönem için çelişen kayıtlar",
        "yuksek",
        "silindi",
        "Aynı ürün-dönem çifti için birden fazla ve birbirinden farklı kayıt bulundu. En son "
        "kayıt doğru kabul edildi (ERP'de düzeltme kaydı genellikle sonradan yazılır).",
    ),
    "IMPUTATION_AMBIGUOUS": (
        "Eksik değer iki yönden farklı hesaplanıyor",
        "yuksek",
        "isaretlendi",
        "Eksik satır, önceki dönemden ileri doğru ve sonraki dönemden geri doğru hesaplandığında "
        "farklı sonuç veriyor. Bu, eksik satırın komşu dönemlerle çeliştiğini gösterir; kaynak "
        "sistemde bu kayıt doğrulanmalı.",
    ),
    "PERIOD_GAP": (
        "Bazı kayıtlarda dönem boşlukları var",
        "orta",
        "isaretlendi",
        "Veri seti {periods} dönem içeriyor ancak bazı kayıtlar tüm dönemlerde bulunmuyor. Trend "
        "hesapları bu kayıtlar için daha az noktaya dayanır.",
    ),
    "ROW_QUARANTINED": (
        "Tamamlanamayan satırlar analiz dışı bırakıldı",
        "yuksek",
        "karantina",
        "Zorunlu alanları eksik olan ve veri setinin kendi iç tutarlılığından türetilemeyen "
        "satırlar. Yanlış sonuç üretmemek için hesaplamalara dahil edilmedi; ham hali ayrıca "
        "saklanıyor.",
    ),
}

# Fixed value: added to an imputation's detail when its two estimates disagree.
AMBIGUOUS_NOTE = (
    " İleri ve geri yönde hesaplanan değerler uyuşmuyor -- veri setinde bu kayıt için gerçek bir "
    "tutarsızlık var. İleri yöndeki değer kullanıldı ve durum raporlandı."
)
# Severity and action of an imputation issue.
IMPUTED = ("orta", "turetildi")
