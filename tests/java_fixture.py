"""A small shop in Java, made for the tests."""

FILES = {
    "src/main/java/shop/Order.java": """package shop;

import jakarta.persistence.Entity;
import jakarta.persistence.Table;

/** A thing somebody <b>bought</b>. It has lines. */
@Entity
@Table(name = "purchase_orders")
public class Order {
    private String id;
    public String id() { return id; }
}
""",
    "src/main/java/shop/Payments.java": """package shop;

public interface Payments {
    String pay(Order order);
}
""",
    "src/main/java/shop/CardPayments.java": """package shop;

import org.springframework.stereotype.Service;
import org.springframework.kafka.core.KafkaTemplate;
import org.springframework.security.access.prepost.PreAuthorize;
import org.springframework.transaction.annotation.Transactional;

@Service
public class CardPayments implements Payments {
    private KafkaTemplate<String, String> template;
    private int tries = 0;

    @Override
    @Transactional
    @PreAuthorize("hasRole('PAYER')")
    public String pay(Order order) {
        tries++;
        if (order == null) throw new IllegalStateException("none");
        template.send("payments.done", order.id());
        return order.id();
    }
}
""",
    "src/main/java/shop/web/OrderController.java": """package shop.web;

import org.springframework.web.bind.annotation.*;
import org.springframework.beans.factory.annotation.Value;
import shop.Order;
import shop.Payments;

@RestController
@RequestMapping("/orders")
public class OrderController {
    private final Payments payments;
    @Value("${shop.limit:10}")
    private int limit;

    public OrderController(Payments payments) {
        this.payments = payments;
    }

    @PostMapping("/{id}/pay")
    public String pay(Order order) {
        return payments.pay(order);
    }
}
""",
    "src/main/java/shop/OrderRepository.java": """package shop;

import org.springframework.data.jpa.repository.JpaRepository;
import org.springframework.data.jpa.repository.Query;

public interface OrderRepository extends JpaRepository<Order, String> {
    @Query("select o from Order o join audit_log a where a.x = 1")
    Order find(String id);
}
""",
    "src/main/java/shop/Listener.java": """package shop;

import org.springframework.kafka.annotation.KafkaListener;

record Receipt(String id, int cents) { }

public final class Listener {
    @KafkaListener("payments.done")
    public void heard(String id) {
        Runnable r = new Runnable() { public void run() { heard("x"); } };
        try { r.run(); } catch (RuntimeException | Error e) { throw e; }
    }
}
""",
    "src/test/java/shop/CardPaymentsTest.java": """package shop;

import org.junit.jupiter.api.Test;

class CardPaymentsTest {
    private CardPayments card;

    @Test
    void shouldRejectMissingOrders() { card.pay(null); }
}
""",
}


def write(root) -> str:
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)
